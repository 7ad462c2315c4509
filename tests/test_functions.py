"""Text forms and alignment against fixed values and properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import align, text

# Reference, prediction, strict counts, canonical counts.
PAIRS = [
    ("يادگیری", "یادگیری", (1, 0, 0), (0, 0, 0)),
    ("كتاب", "کتاب", (1, 0, 0), (0, 0, 0)),
    ("می روم", "می‌روم", (1, 0, 0), (1, 0, 0)),
    ("میروم", "می‌روم", (0, 0, 1), (0, 0, 1)),
    ("۱۲۳", "123", (3, 0, 0), (0, 0, 0)),
    ("۱۲۳۴", "۱۲۳", (0, 1, 0), (0, 1, 0)),
    ("۱۴۰۳/۰۲", "۱۴۰۳/۰۲/۰۱", (0, 0, 3), (0, 0, 3)),
    ("سلام", "سلام سلام سلام", (0, 0, 10), (0, 0, 10)),
    ("", "متن ساختگی", (0, 0, 10), (0, 0, 10)),
    ("kitten", "sitting", (2, 0, 1), (2, 0, 1)),
    ("ab", "ba", (2, 0, 0), (2, 0, 0)),
]


def test_pairs():
    for a, b, strict, canonical in PAIRS:
        assert align.counts(a, b) == strict
        assert align.counts(text.canonical_text(a), text.canonical_text(b)) == canonical
        s, d, i = strict
        assert align.counts(b, a) == (s, i, d)


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc ‌", max_size=12), st.text("abc ‌", max_size=12))
def test_alignment_properties(a, b):
    s, d, i = align.counts(a, b)
    assert d - i == len(a) - len(b) and s + d + i == plain(a, b)
    moves = align.path(a, b)
    assert (moves.count("S"), moves.count("D"), moves.count("I")) == (s, d, i)
    assert align.counts(a, a) == (0, 0, 0)


def test_spacing_examples():
    assert align.spacing("می‌روم", "می روم")[1] == 1 and align.spacing("می‌روم", "می روم")[5] == 1
    assert align.spacing("دانشگاه تهران", "دانشگاهتهران")[2] == 1
    same = align.spacing("می‌روم خانه", "می‌روم خانه")
    assert same[0] == 1 and same[3] == 1 and sum(same) == 2


def test_omission_and_numbers():
    assert align.longest_omission(align.path("abcdef", "af")) == 4
    assert align.numeric(align.path("abc 12 d", "abc 13 d"), [(4, 6, "12")], [(4, 6, "13")]) == ([False], 0)
    assert align.numeric(align.path("abc", "abc 5"), [], [(4, 5, "5")]) == ([], 1)


def table_path(a, b):
    """The path by the whole table of (distance, insertions and deletions), from the end."""
    n, m = len(a), len(b)
    t = [[(i + j, i + j) if not i or not j else None for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = min((t[i - 1][j - 1][0] + (a[i - 1] != b[j - 1]), t[i - 1][j - 1][1]), *((x + 1, y + 1) for x, y in (t[i - 1][j], t[i][j - 1])))
    i, j, out = n, m, ""
    while i or j:
        if i and j and t[i][j] == (t[i - 1][j - 1][0] + (a[i - 1] != b[j - 1]), t[i - 1][j - 1][1]):
            out, i, j = ("=" if a[i - 1] == b[j - 1] else "S") + out, i - 1, j - 1
        elif i and t[i][j] == (t[i - 1][j][0] + 1, t[i - 1][j][1] + 1):
            out, i = "D" + out, i - 1
        else:
            out, j = "I" + out, j - 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_path_is_that_of_the_whole_table(a, b):
    assert align.path(a, b) == table_path(a, b) and align.move_counts(align.path(a, b)) == align.counts(a, b)


def test_long_lines_need_little_memory():
    import random
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=6000))
    b = "".join(c for c in a if rng.random() > 0.1)
    tracemalloc.start()
    moves = align.path(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert align.move_counts(moves) == align.counts(a, b) and most < 20e6  # 200 MB at 20,000 characters


def test_canonical(spark):
    rows = [("ﻻ",), ("ـa b  c",), ("‏x‌y",), (None,), ("",), ("﻿z",)]
    out = [r.c for r in spark.createDataFrame(rows, "t string").select(text.canonical("t").alias("c")).collect()]
    assert out == ["لا", "a b  c", "x‌y", None, "", "﻿z"]
    assert [text.canonical_text(r[0]) for r in rows if r[0] is not None] == [o for o in out if o is not None]


def test_small_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        text.strict(F.lit("a\r\nb\n"), True).alias("strict"),
        text.visible(F.lit("a b‌c\t")).alias("visible"),
        text.tokens(F.lit("در 09:30، می‌روم (AI)")).alias("tokens"),
        text.numeric_value(F.lit("۲۵۰٬۰۰۰"), F.lit("price"), F.lit(False)).alias("price"),
        text.numeric_value(F.lit("۱۵٪"), F.lit("percentage"), F.lit(False)).alias("percent"),
        text.numeric_value(F.lit("۰۹:۳۰"), F.lit("time"), F.lit(True)).alias("time"),
        text.numeric_value(F.lit("۱۴۰۵/۰۴/۲۳"), F.lit("date"), F.lit(False)).alias("date"),
    ).first()
    assert row.strict == "a\nb" and row.visible == "a[SP]b[ZWNJ]c[TAB]"
    assert row.tokens == ["در", "09:30", "،", "می‌روم", "(", "AI", ")"]
    assert (row.price, row.percent, row.time, row.date) == ("250000", "15%", "09:30", "1405/04/23")


def test_span_locator(spark):
    import pytest

    t = "از ۱۳۹۸/۱۱/۰۲ تا ۰۷:۱۵ باران آمد و ۳۲٬۵۰۰ ریال با ۸٪ سود ماند"
    raws = [("date", "۱۳۹۸/۱۱/۰۲"), ("time", "۰۷:۱۵"), ("price", "۳۲٬۵۰۰"), ("percentage", "۸٪")]
    df = spark.createDataFrame([(t, raws)], "t string, r array<struct<type:string,raw:string>>")
    got = df.select(text.numeric_spans(df.t, df.r).alias("s")).first().s
    assert [(x.start, x.end, x.preserve_leading_zero) for x in got] == [(t.index(r), t.index(r) + len(r), r[0] == "۰") for _, r in raws]
    bad = spark.createDataFrame([(t, [("x", "نیست")])], "t string, r array<struct<type:string,raw:string>>")
    with pytest.raises(Exception, match="no such span"):
        bad.select(text.numeric_spans(bad.t, bad.r)).collect()


def _table_path(a, b):
    """(cost, path) by the whole table."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                ways = [t[i - 1][j] + align.B] if i else []
                ways += [t[i][j - 1] + align.B] if j else []
                ways += [t[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else align.B - 1)] if i and j else []
                t[i][j] = min(ways)
    i, j, out = n, m, []
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else align.B - 1):
            out.append("=" if a[i - 1] == b[j - 1] else "S")
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + align.B:
            out.append("D")
            i -= 1
        else:
            out.append("I")
            j -= 1
    return "".join(reversed(out))


def test_paths_in_parts_are_those_of_the_table(monkeypatch):
    rng = random.Random(8)
    for trial in range(400):
        letters = "ab" if trial % 2 else "abcdef"
        a = "".join(rng.choices(letters, k=rng.randrange(25)))
        b = list(a) if trial % 3 else rng.choices(letters, k=rng.randrange(25))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices(letters, k=rng.randrange(3))
        b = "".join(b)
        want = _table_path(a, b)
        monkeypatch.setattr(align, "CELLS", 1 << 22 if trial % 4 else 8)
        monkeypatch.setattr(align, "PARTS", 16 if trial % 8 else 2)
        assert align.path(a, b) == want, (a, b)
        assert align.counts(a, b) == align.counts(list(a), list(b)) == (want.count("S"), want.count("D"), want.count("I"))
        x, y = align._codes(a, b)
        assert align.distance(x, y) == len(want) - want.count("=")


def test_long_paths_need_little_memory():
    import tracemalloc

    rng = random.Random(9)
    a = "".join(rng.choices("abcdefgh ", k=20_000))
    b = a.replace("abc", "").replace("ha", "ah")
    tracemalloc.start()
    moves = align.path(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert align.move_counts(moves) == align.counts(a, b) and peak < 30e6


def test_inert_texts_are_composed():
    import re
    import unicodedata

    inert = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", text.inert()) + "]*")
    assert inert.fullmatch("سلام دنیا\u200c، élan") and not inert.fullmatch("e\u0301") and not inert.fullmatch("ﻻ") and not inert.fullmatch("ا\u0653")
    alphabet = [chr(c) for lo, hi in text.COMMON_BLOCKS for c in range(lo, hi + 1) if inert.fullmatch(chr(c))]
    rng = random.Random(3)
    for _ in range(3000):
        x = "".join(rng.choices(alphabet, k=8))
        assert unicodedata.normalize("NFC", x).translate(text.presentation_forms()) == x


def test_distance_by_pieces_is_the_distance(spark):
    """Where letters only go, where some are exchanged (no piece's lengths differ then), and over texts that no band of the whole could get through in time."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [("".join(rng.choices("thab ", k=rng.randint(0, 60))),) for _ in range(200)] + [("",), (None,), ("th",), ("thth" * 8,)]
    frame = spark.createDataFrame(rows, "x string")
    for old, new in (("th", "t"), ("th", "ht"), ("th", "xyz"), ("th", "")):
        lost = lambda c, old=old, new=new: F.replace(c, F.lit(old), F.lit(new))
        got = frame.select(text.distance_by_pieces(F.col("x"), lost(F.col("x")), F.split("x", "(?<=th)"), lost).alias("d"), F.levenshtein("x", lost(F.col("x"))).alias("w"))
        assert got.where("NOT d <=> w").isEmpty()
    long = spark.createDataFrame([("th" * 300_000 + "b" * 100_000,)], "x string")
    lost = lambda c: F.replace(c, F.lit("th"), F.lit("t"))
    assert long.select(text.distance_by_pieces(F.col("x"), lost(F.col("x")), F.split("x", "(?<=th)"), lost)).first()[0] == 300_000
