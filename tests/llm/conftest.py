import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with extra columns whose names clash."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], ["a", None, "b"][k % 3], 7, "clash", -1) for k, (i, t) in enumerate(rows)], DOCS)

    return make


#: Texts that every operator must take: null, empty, blank, short, long, repeated, odd characters.
ODD = [None, "", " \n\t ", "one", "one", "a b c d", "x " * 30_000, "é ü z\n\nq \n r", "<|endoftext|> it's <|im_end|>", "\x1c\x1d 1 2 3 !?", "\n".join(["same line here"] * 40), "Σίσυφος ΣΑΣ İ ß", "tail <"]
