"""Small tables with the odd cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, size long"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    long_text = " ".join(f"word{i % 977} filler{i % 13}" for i in range(12000))
    texts = [
        (0, "the same words are here. and a second sentence stands here.\nline two of it", "en", "a"),
        (1, "the same words are here. and a second sentence stands here.\nline two of it", "en", "a"),
        (1, "the same words are here. and a second sentence stands here.\nline two of it", "en", "a"),
        (2, "", "en", "b"),
        (3, None, None, None),
        (4, "   \t\n ", "de", "b"),
        (None, "a row without an id", None, "c"),
        (5, long_text, "en", "a"),
        (6, long_text + " tail", "en", None),
        (7, "x", "fr", ""),
        (8, "Ünïcödé ΑΣ   \x1c é 日本語 <|endoftext|> it's 42%%", "fr", "é"),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "clash", 7, -1) for i, t, l, s in texts], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], EMPTY)
