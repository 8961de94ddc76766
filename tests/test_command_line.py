"""Each command over the small golden curves, file to file."""

from tests.test_trajectories import TINY, frame

from dyadica.__main__ import main
from dyadica.sources import tables


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_commands(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    tables.write_points(frame(spark, TINY), at("in"))
    assert main(["mine", at("in"), at("half"), "-r", "1", "-f", "0.5"])["pathlets"] == 24
    assert main(["mine", at("in"), at("maximal"), "-r", "1", "-f", "0.5", "-m"])["pathlets"] == 4
    assert sorted(lines(spark, at("maximal")))[0] == "0 1 2 0.75"
    assert main(["vcdim", at("in"), "-r", "1"])["dimension"] == 2
    assert main(["sample", at("in"), at("drawn"), "-m", "0", "-c", "2"])["drawn"] == 2
    assert len({x.split()[2] for x in lines(spark, at("drawn"))}) == 2
    report = main(["cluster", at("in"), at("clusters"), "-m", "center", "-d", "1", "1", "-s", "0"])
    assert report["clusters"] >= 1 and lines(spark, at("clusters"))[:2] == ["in", "center"]
    assert main(["cluster", at("in"), at("longest"), "-m", "longest", "-d", "1", "1", "--size", "2", "--csv"])["clusters"] == 1
    assert all(x.startswith(".,.,.,.,0,") for x in lines(spark, at("longest")))
