"""Documents for the operators: a driver table and hand-made cases."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, fp long, spans string"


def edge_docs(spark):
    """Nulls, empty, short, long, repeated, case and white-space cases, with extra columns whose names operators use inside."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [
        None,
        "",
        "   \t\n ",
        "one",
        "One two\x0bthree",
        "a b c d e f",
        "be " * 200,
        passage,
        "x y z " + passage + " q",
        passage.upper(),
        "pre " * 3 + passage[:90] + " tail " + passage[40:],
        "Été naïve 日本 \U0001f600   \x1c x",
        " ".join(f"w{i % 977}" for i in range(30_000)),
        "line one\nline two\nline one\n\nline one \n" * 9,
        "#$ % & | < > * spam " * 20,
        "alpha beta gamma delta " * 30,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None, "k", i, 0, "z") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (100, passage, "en", None, 1, None, None, None, None), (None, passage + " more", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def all_docs(spark, sf):
    """(doc_id, text) of the driver's small table and the hand-made cases, ids apart."""
    own = edge_docs(spark).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang")
    return table(spark, sf, "documents").select("doc_id", "text", "lang").union(own)


def words(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()
