import pytest

LONG = ("The long text goes on, word after word; it never ends. " * 12_000).strip()  # 660,000 characters
TRICKY = [
    (1, "Plain words of a first document, enough of them to count.", "en", "s", 1),
    (1, "Plain words of a first document, enough of them to count.", "en", "s", 1),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (4, " \t\n\x0b\x0c\r ", "fr", "s", 7),
    (5, "word", "fr", "s", 4),
    (6, "Plain  words of a first\tdocument, enough of them to count.", "en", "s", 2),
    (7, LONG, "en", "s", len(LONG)),
    (8, "12345 67890 !!! ??? 4111 1111 1111 1111", "fr", "s", 9),
    (9, "漢字かな交じり文 mit ß und é 😀 <|turn|> a b", "de", "s", 9),
    (None, "An id that is null, with a text that is not.", "en", "s", 3),
    (10, "\x00\x01 control \x7f and ' quotes \" \\ $ % here", "en", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["id", "row", "key", "mark", "n", "u", "v", "c", "bands", "s1", "s2", "score", "lang_pred", "ids", "kept", "n_tokens", "label", "item_id", "_id", "Text_"]


def write_tables(spark, folder, docs, labels=None, benchmark=None, conversations=None, embeddings=None):
    frame = docs
    for c in CLASHING:
        frame = frame.selectExpr("*", f"'x' AS {c}")
    frame.write.parquet(f"{folder}/documents.parquet")
    labels = labels if labels is not None else spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, 1, None), (8, None, 0), (None, 0, 1), (99, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    labels.selectExpr("*", "'x' AS text", "1.5D AS score").write.parquet(f"{folder}/labels.parquet")
    benchmark = benchmark if benchmark is not None else spark.createDataFrame([(1, "words of a first document, enough of them"), (2, None), (3, ""), (4, "two words"), (1, "words of a first document, enough of them")], "item_id long, text string")
    benchmark.selectExpr("*", "'x' AS doc_id").write.parquet(f"{folder}/benchmark.parquet")
    conversations = conversations if conversations is not None else spark.createDataFrame(
        [(1, 1, "assistant", "b <|done|> <~|x"), (1, 0, "user", None), (1, 1, "assistant", "b <|done|> <~|x"), (2, None, None, ""), (2, 3, "assistant", ""), (None, 0, "user", "x"), (3, 0, "assistant", LONG), (4, 0, "assistant", "a<"), (4, 1, "assistant", "|b 😀é")], "conv_id long, turn long, role string, text string"
    )
    conversations.selectExpr("*", "'x' AS said", "'x' AS turns").write.parquet(f"{folder}/conversations.parquet")
    embeddings = embeddings if embeddings is not None else spark.createDataFrame(
        [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, [0.9, 0.4], 1), (3, [0.8, 0.4], 2), (3, [0.8, 0.4], 2), (7, [0.7, 0.3], 0), (14, [0.7, 0.3], 2), (None, [0.6, 0.3], 3), (4, None, 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 2), (8, [0.5, 0.5], None), (9, [float("inf"), 1.0], 2)], "vec_id long, embedding array<float>, label int"
    )
    embeddings.selectExpr("*", "'x' AS row", "'x' AS v", "'x' AS block").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def tricky(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("tricky"), spark.createDataFrame(TRICKY, SCHEMA))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    empty = lambda s: spark.createDataFrame([], s)
    return write_tables(spark, tmp_path_factory.mktemp("nothing"), empty(SCHEMA), empty("doc_id long, quality int, toxic int"), empty("item_id long, text string"), empty("conv_id long, turn long, role string, text string"), empty("vec_id long, embedding array<float>, label int"))
