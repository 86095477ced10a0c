import pytest

LONG = "Wordy " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns named as results are."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (2, "The quick brown  fox jumps\tover the lazy dog near the river bank", None, None, None),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 3), (None, "Der schnelle braune Fuchs springt", "de", "b", 2),
        (None, "Der schnelle braune Fuchs springt", "de", "b", 2), (None, None, None, None, None), (6, LONG, "en", "b", len(LONG)),
        (7, "x", "de", "b", 1), (8, "12345 !!", "de", "b", 8), (9, "漢字 🙂 é <|endoftext|> ½", "de", "b", 1),
    ]
    extra = [("z", "z", "z", "z", 0, 0.5, "z")] * len(rows)
    names = "digest, kept, lang_pred, set_key, start, score, leaf".split(", ")
    kinds = ["string", "string", "string", "string", "int", "double", "string"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return spark.createDataFrame([a + b for a, b in zip(rows, extra, strict=True)], schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
