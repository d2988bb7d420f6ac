"""Documents with the odd cases every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_at(start, count, step=7):
    return " ".join(f"w{(start + i * step) % 997}x" for i in range(count))


def odd_documents():
    """Nulls everywhere, empty and long texts, ties, repeated rows and near copies."""
    base = words_at(1, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    texts = [
        (1, base, "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, base.upper(), "de", "b"),
        (4, None, None, None),
        (5, "", "en", ""),
        (6, " \n\t ", "en", "a"),
        (7, "one two", "fr", "c"),
        (8, "One  two", "fr", "c"),
        (9, "... 123 !!!", "en", "a"),
        (10, words_at(5, 6000, 11), "en", "a"),
        (11, words_at(5, 6000, 11) + " tail", "en", None),
        (12, " ".join(far), None, "b"),
        (13, "Straße über Ärger\nÉtat 日本語 x" * 9, "de", "b"),
        (13, "Straße über Ärger\nÉtat 日本語 x" * 9, "de", "b"),
        (None, "a text without an id that stands alone", "en", "a"),
        (None, None, None, None),
        (14, "x" * 5000, "en", "a"),
        (15, "a b a b c", "fr", "c"),
    ]
    texts += [(100 + i, f"shared line\n{words_at(i * 31, 40)}\n  SHARED Line  ", "en", f"s{i % 4}") for i in range(14)]
    return [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in texts]


def odd_frame(spark, extra=False):
    rows = odd_documents()
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    names = "component_id string, keep_id string, kept string, size string, taken string, n_lines string, rank string"
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], f"{SCHEMA}, {names}")


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
