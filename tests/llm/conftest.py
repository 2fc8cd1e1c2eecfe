import os
import sys

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the small documents table (null as empty)."""
    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with nulls, empty, blank and long texts, repeated rows and ids, ties, and
    columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("edge"))
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \n\t ", None, "a", 4), (3, "one", "en", "a", 3),
            (3, "one", "en", "a", 3), (4, "x " + passage, "en", "b", 1), (5, passage + " y", "de", "b", 1),
            (None, passage, "de", "b", 1), (6, long, "en", "a", 1), (7, long + " z", "en", "a", 1), (7, "der die das", "de", "", 1),
            (8, "12 34 ## !!", "en", "c", 1), (9, "▁a  b c \x00 é漢🙂 <|endoftext|> <s>", "de", "c", 1)]
    clash = ["sig", "th", "words", "term", "rid", "bucket", "score", "spots", "h", "gram", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    spark.createDataFrame([(*d, *clash) for d in docs], schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    html = "<html><body><nav>m</nav><article><h1>A &amp; B</h1><p>one<br>two</p></article><footer>f</footer></body></html>"
    pages = [(0, None, None), (1, "http://h.x/a", ""), (2, "http://h.x/b", html), (2, "http://h.x/b", html), (None, "no url", "<p>q"),
             (4, "http://h.x/c", "<p " * 50), (5, "http://h.x/d", html.replace("one", "x " * 20_000))]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("x", "x").selectExpr(
        "*", "'c' AS host", "'c' AS learned", "'c' AS place").coalesce(1).write.parquet(f"{path}/pages.parquet")
    nan = float("nan")
    vectors = [(0, [0.5, 0.25, 0.0], 1), (50, [0.5, 0.25, 0.0], 1), (50, [0.5, 0.25, 0.0], 1), (1, [0.4, 0.2, 0.1], 2), (2, [0.0, 0.0, 0.0], 2),
               (3, None, 1), (4, [0.1, None, 0.2], 1), (5, [nan, 0.0, 0.0], 1), (6, [0.1, 0.1, 0.1], None), (None, [0.3, 0.3, 0.0], 2),
               (7, [], 2), (8, [0.5], 2), (9, [1e30, -1e30, 0.0], 3)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "'c' AS rid", "'c' AS x", "'c' AS score", "'c' AS norm").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    chats = [(0, 0, "user", None), (0, 1, "assistant", None), (1, 0, "user", "a b c d e"), (1, 0, "user", "a b c d e"),
             (1, 1, "assistant", 'say "hi"\n'), (2, 1, "assistant", "lost"), (None, 0, "user", "q w e r t"), (3, None, "user", "u"),
             (4, 0, "system", "s"), (4, 1, "tool", "t")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'c' AS node", "'c' AS kind", "'c' AS position").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path
