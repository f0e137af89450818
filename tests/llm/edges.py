"""Rows that every operator on documents must take: nulls, empty and long texts, ties, clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i % 977) for i in range(60_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, hash string, bucket int, key string, row int"
# Names that operators give to their own new columns.
MADE = "ids string, decoded long, spans int, lang_pred long, SCORE string, n_tokens string, sha int, finish string, doc long, order int, tied int, winners int"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree"


def rows():
    extra = (1, True, "h", 2, "k", 3)
    texts = [
        (1, BASE, "en", "b"),
        (2, BASE, "en", "b"),
        (2, BASE, "en", "b"),
        (3, BASE.replace(" ", "  ") + "\n", "en", "a"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " \t\n", "en", "a"),
        (7, LONG, "en", "b"),
        (8, LONG + " end", None, "b"),
        (None, "no id here at all but words", "en", None),
        (None, None, "en", "c"),
        (9, "123 456 !!", "en", "c"),
        (10, "Straße\x00 ΟΔΥΣΣΕΥΣ İstanbul été 中文字 😀 <|endoftext|>", "de", "c"),
    ]
    return [(*t, None if t[1] is None else len(t[1]), *extra) for t in texts]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, COLUMNS)


def clashing(spark, data=None):
    """The same rows with more columns, named like the operators' new ones."""
    more = ("i", 1, 2, 3, "s", "t", 4, "f", 5, 6, 7, 8)
    return spark.createDataFrame([(*r, *more) for r in (rows() if data is None else data)], f"{COLUMNS}, {MADE}")
