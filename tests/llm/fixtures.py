"""Rows that every corpus operator has to get through."""

ODD_TEXTS = [
    None, "", " ", "  ", "\n\n\n", "a", " a", "a ", "a  b", "word", "don't we'll I'm", "▁a", "a▁b ▁", "tab\tand\r\nline",
    "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "</s> <s> <unk> <0x0A>", "\x00nul", "naïve café über straße", "日本語 テキスト", "🙂🙃 👩‍👩‍👧",
    "՘ ֋౜xᲉ \U0001d6a6 \U000323b0a1", "é combining é", "　wide space em", "x" * 5000, "ab " * 9000, "longword" * 400 + " end",
    "12345 1.5e10 -7", "ﬁ ﬂ ﷺ", "ÄÖÜ äöü", "﻿bom", "a​b", "½ ² 12", "same text", "same text",
]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, extra=""):
    """Odd texts, a repeated row, a row of nulls and columns whose names clash with results."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(5, "a", "en", "s", 1), (None, None, None, None, None), (-3, "negative id", None, "s", 11)]
    return spark.createDataFrame(rows, DOC_SCHEMA)
