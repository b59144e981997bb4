import random
import re

from tessera.llm.repetition import MOST, MOST_LINES, ONCE, gram_shares, keep_clean, line_shares, repetition

import pyarrow as pa


def brute_force(text):
    """Shares of bytes in repeated n-grams, and in repeated lines, of one text."""
    text = text or ""
    words = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    sizes = [len(w.encode()) for _, w in words]
    out = {}
    for n in MOST:
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(w for _, w in words[i : i + n])
            if gram in seen:
                covered.update(range(i, i + n))
            seen.add(gram)
        out[n] = sum(sizes[i] for i in covered) / max(1, sum(sizes))
    lines = [x for x in text.split("\n") if x.strip(" \t\r")]
    seen, twice = set(), 0
    for x in lines:
        twice += len(x.encode()) * (x in seen)
        seen.add(x)
    return out, twice / max(1, sum(len(x.encode()) for x in lines))


def once(text):
    """By n, and for lines under 0: whether one run of words, or one line, is there again, once, and no other."""
    words = [m.group().lower() for m in re.finditer(r"[^\W_]+", text or "")]
    out = {}
    for n in MOST:
        seen, again = {}, []
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            seen[gram] = seen.get(gram, 0) + 1
            if seen[gram] > 1:
                again.append(i)
        out[n] = len(again) > 0 and again == list(range(again[0], again[-1] + 1)) and max(seen.values()) == 2
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r")]
    out[0] = len(lines) - len(set(lines)) == 1
    return out


def kept(text):
    grams, line = brute_force(text)
    single = once(text)
    shares = [(line, MOST_LINES, single[0]), *((grams[n], MOST[n], single[n]) for n in MOST)]
    return bool(re.search(r"[^\W_]", text or "")) and all(s <= m or (one and s < ONCE) for s, m, one in shares)


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    out = ["", None, "...", "a", "x " * 300, "one line\n" * 40, "\n\n \n", "a b c d e f g h i j k " * 20]
    for _ in range(40):
        line = " ".join(word() for _ in range(rng.randint(1, 30)))
        out.append("\n".join(rng.choice([line, " ".join(word() for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(1, 12))))
    return out


def test_shares_against_brute_force():
    rows = texts()
    _, grams = gram_shares(pa.array(rows))
    lines = line_shares(pa.array(rows))
    for i, text in enumerate(rows):
        want, line = brute_force(text)
        assert abs(lines[i] - line) < 1e-9 and all(abs(grams[n][i] - want[n]) < 1e-9 for n in MOST), repr(text)


def test_verdicts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.keep for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: kept(t) for i, t in rows} and 5 < sum(got.values()) < len(rows) - 5


def test_operator(spark):
    rng = random.Random(1)
    clean = " ".join("".join(rng.choice("aeioustn") for _ in range(6)) for _ in range(3000))
    rows = [(1, clean, "x"), (2, clean[:400] + "\n" + clean[:60], "x"), (3, "spam and eggs are here again " * 90, "x"), (4, None, "x"), (5, "", "x"), (None, clean, "x"), (1, clean, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    got = repetition(df).collect()
    assert sorted((r.doc_id, r.keep) for r in got) == [(1, True), (1, True), (2, True), (3, False), (4, False), (5, False)]
    for r in got:
        assert r.keep == kept(next(t for i, t, _ in rows if i == r.doc_id))
    assert sorted(map(tuple, keep_clean(df).collect())) == [(1, clean, "x"), (1, clean, "y"), (2, rows[1][1], "x")]
    assert keep_clean(df.limit(0)).collect() == [] and repetition(df.limit(0)).collect() == []


def test_only_a_single_repeat_is_forgiven(spark):
    line = "We close at noon on all of the bank holidays"
    rest = " ".join(f"w{i}" for i in range(20))
    rows = [
        (1, "\n".join(["SHOU.!! THE.!!"] * 5), False),  # only repetition
        (2, "\n".join(["BE!! SCUM!! SCUM!! TION!! A.!!"] * 5), False),
        (3, "\n".join([line, rest, line]), True),  # one line said twice
        (4, "\n".join([line, line, rest, line]), False),  # and three times
        (5, "one two three four five. " * 3 + rest, False),
        (6, "\n".join(["a first line", "the second", "a first line", "the second"]), False),  # two lines
        (7, "one two three four five a b six seven eight nine ten c d one two three four five e f six seven eight nine ten", False),  # two runs
        (8, f"{rest}\n{rest}", False),  # nothing but something said twice
        (9, "\n".join(["buy now cheap pills today"] * 5), False),
        (10, "\n".join([" ".join(f"v{i}" for i in range(900)), " ".join(f"u{i}" for i in range(50)), " ".join(f"v{i}" for i in range(900))]), True),  # the same rule for long ones
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.keep for r in repetition(df).collect()} == {i: keep for i, _, keep in rows}
    assert {r.doc_id for r in keep_clean(df).collect()} == {3, 10}
