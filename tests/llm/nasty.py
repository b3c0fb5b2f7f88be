"""Tables with nulls everywhere, empty and very long texts, repeated rows, ties and clashing extra columns."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, _text string, score double, copy int, label int"

WORDS = "the quick brown fox jumps over a lazy dog and then it runs back home, where the others wait for supper. ".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * 7 + i // 5 * seed + seed) % len(WORDS)] + ("" if i % 3 else str((i * seed) % 17)) for i in range(n))


def doc(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), None, "x", "clash", None, 7, None)


def nasty_rows():
    long = prose(40_000, 3)
    return [
        doc(1, prose(120, 1)), doc(2, prose(120, 1)), doc(2, prose(120, 1)), doc(3, None), doc(4, ""), doc(5, " \n\t "), doc(6, "one"), doc(7, "one"),
        doc(8, long), doc(9, long + " more"), doc(None, prose(120, 1)), doc(None, None, None, None), doc(10, "x" * 200_000), doc(11, "Mail a.b@c.org, call +1 (555) 010-9999 or 10.0.0.1; card 4111 1111 1111 1111." * 3, None),
        doc(12, "日本語 naïve \U0001f600 \x00 İstanbul ΣΑΣ <|endoftext|> it's", None), doc(13, prose(119, 1) + " changed"), doc(14, "\n".join(["same line here"] * 50)), doc(2, prose(60, 9)), doc(-5, prose(60, 9)),
    ]


def nasty_docs(spark):
    return spark.createDataFrame(nasty_rows(), DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def nasty_labels(spark):
    rows = [(1, 1, 0, "x"), (1, 1, 0, "x"), (2, 1, 0, None), (2, 0, 1, None), (None, 1, 1, None), (14, 0, 1, None), (13, None, None, None), (11, 1, 0, None), (999, 0, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
