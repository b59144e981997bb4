"""Personal data in texts, found by a character-level bidirectional LSTM with CRF transitions.

The model is trained in numpy from labelled spans: values of each kind are drawn, set into lines of the corpus that
hold none, and labelled where they stand. Texts are cut into overlapping windows, each decoded by Viterbi; a character
takes its tag from the window in which it stands farther from an edge, and the spans of a text are then reconciled:
parts of one value become one span, and a value found once is marked wherever the text repeats it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import documents
from tessera.llm.shared import sample as texts
from tessera.llm.tagger import Tagger
from tessera.llm.tokens import flat, slices

KINDS = ("email", "phone", "ip", "card", "secret", "account")
#: Texts whose lines are the background of training, those whose ids have the smallest hashes.
SAMPLE = 300
#: Characters of a window, and how many two windows share: more than the longest value.
WINDOW, SHARED = 1024, 80
#: Training: steps, windows in a step, their characters, and the hidden units of each direction.
STEPS, BATCH, LENGTH, HIDDEN = 750, 48, 112, 8
#: Windows decoded at a time.
LOT = 512
#: Bytes of texts that are tagged at a time; a longer text comes whole.
SLICE = 1 << 20
#: Figures that a value has at least, by the definition of its kind; an email address has an ``@``. Of 3,000 texts of the
#: test tables, 35 without personal data are left alone for it, and of 314 values none is lost.
FIGURES = {"phone": 7, "ip": 4, "card": 13, "secret": 2, "account": 7}

_SIGNS = "\n \t@.-_+()=\"':/#%$&*!|,;?<>[]{}~"
#: A symbol for each byte: letters one by one without case, one for capitals, digits, other bytes of text.
SYMBOLS = np.zeros(256, np.uint8)
for _i in range(26):
    SYMBOLS[97 + _i] = 1 + _i
SYMBOLS[65:91] = 27
SYMBOLS[48:58] = 28
SYMBOLS[128:] = 29
for _i, _c in enumerate(_SIGNS):
    SYMBOLS[ord(_c)] = 30 + _i
_PART = np.zeros(256, bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = True
_PART[128:] = True
_COUNT = 30 + len(_SIGNS)


def value(kind: str, rng: random.Random) -> str:
    """A made-up value of a kind."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a=2, b=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    if kind == "email":
        if rng.random() < 0.3:  # names with letters outside ASCII
            w = lambda a=2, b=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèêçàñóíüöäß") for _ in range(rng.randint(a, b)))
        name = rng.choice([f"{w()}.{d(rng.randint(1, 2))}", f"{w()}.{w()}", f"{w()}_{w()}", w(3, 12), f"{w()}{d(rng.randint(1, 4))}", f"{w()}+{w(2, 5)}", f"{w().capitalize()}.{w().capitalize()}"])
        return f"{name}@{rng.choice([f'{w()}{d(1)}.{w()}.{rng.choice(['com', 'org', 'net'])}', f'{w()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}', f'{w()}.{w()}.{rng.choice(['com', 'org', 'co.uk'])}', f'{w()}-{w()}.com'])}"
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {d(2)} {d(4)} {d(4)}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"+1{a}{b}{c}", f"+49 {d(3)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, rng.choice([9, 99, 255, 255]))) for _ in range(4))
    if kind == "card":
        p = [d(4) for _ in range(4)]
        return rng.choice(["".join(p), " ".join(p), "-".join(p), d(rng.randint(13, 19))])
    if kind == "secret":
        hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        return rng.choice([hexa(rng.choice([32, 40, 56, 64, 96])), hexa(rng.randint(28, 64)), f"sk-{''.join(rng.choice('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') for _ in range(rng.randint(24, 48)))}", f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}", f"ghp_{''.join(rng.choice('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') for _ in range(36))}"])
    return rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{rng.choice(['DE', 'FR', 'ES', 'NL'])}{d(20)}"])


def harmless(rng: random.Random) -> str:
    """Figures and signs that are no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([d(1), d(2), d(3), d(4), d(5), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}.{d(2)}", f"$ {d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}/{d(2)}/19{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)}%", f"#{d(3)}", f"({d(4)})", f"@ {d(1)}", "version 2.0", "CC BY-NC 4.0.", f"https://www.example.com/{d(3)}", f"{d(2)}-{d(2)}", f"a = \"{d(2)}\"", "= \"word\""])


def example(line: str, rng: random.Random) -> tuple[bytes, np.ndarray]:
    """A stretch of a line with values set into it, and the tag of each byte."""
    words = line.split(" ")
    sign = lambda: rng.choice("#%$&*!~^|") * rng.randint(1, 4)
    noise = sign() if rng.random() < 0.15 else ""
    parts: list[tuple[str, int]] = []
    chance = rng.choice([0.0, 0.08, 0.2])
    for word in words:
        if rng.random() < chance:
            k = rng.randrange(len(KINDS))
            if KINDS[k] == "secret" and rng.random() < 0.6:
                lead = rng.choice(["token", "api_key", "secret", "password", "key"]) + rng.choice([" = ", ": ", "="])
                parts += [(lead + '"', 0), (value("secret", rng), k + 1), ('"', 0)]
            else:
                parts.append((value(KINDS[k], rng), k + 1))
            parts.append((rng.choice(["", "", "", ".", ",", ")", sign(), sign()]) + rng.choice([" ", " ", "\n"]), 0))
            if rng.random() < 0.2:  # the same value again
                again = next(p for p in reversed(parts) if p[1])
                parts += [again, (" ", 0)]
        elif rng.random() < 0.07:
            parts.append((harmless(rng) + " ", 0))
        parts.append((word + (noise if noise and rng.random() < 0.8 else "") + " ", 0))
    if rng.random() < 0.12:
        parts = [(p.upper(), t) for p, t in parts]
    raw = [p.encode() for p, _ in parts]
    tags = np.repeat([t for _, t in parts], [len(r) for r in raw])
    whole = b"".join(raw)
    start = rng.randint(0, max(0, len(whole) - LENGTH))
    length = LENGTH if rng.random() < 0.8 else rng.randint(1, LENGTH)
    return whole[start : start + length], tags[start : start + length]


def train(lines: list[str], steps: int = STEPS, seed: int = 0) -> Tagger:
    """A model from background lines; those with an ``@`` or four digits in a row are left aside."""
    clean = [x for x in lines if "@" not in x and not any(a.isdigit() and x[i : i + 4].isdigit() for i, a in enumerate(x)) and " = " not in x] or ["no text at all"]
    rng = random.Random(seed)
    model = Tagger(_COUNT, len(KINDS) + 1, HIDDEN, seed)
    for step in range(steps):
        x = np.zeros((LENGTH, BATCH), np.uint8)
        y, mask = np.zeros((LENGTH, BATCH), np.int64), np.zeros((LENGTH, BATCH), bool)
        for n in range(BATCH):
            line = rng.choice(clean)
            at = rng.randint(0, max(0, len(line) - 100))
            text, tags = example(line[at : at + 140], rng)
            raw = np.frombuffer(text, np.uint8)
            x[: len(raw), n], y[: len(raw), n], mask[: len(raw), n] = SYMBOLS[raw], tags, True
        mask[0] = True
        _, grad = model.loss(x, y, mask)
        model.update(grad, 0.02 * (1 if step < steps * 0.6 else 0.4 if step < steps * 0.85 else 0.1))
    return model


def tags_of(model: Tagger, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tag of every byte of every text, after its windows are decoded and reconciled; bytes, and texts' starts."""
    data, offsets = flat(column)
    symbol = np.append(SYMBOLS[data], 0)
    size = np.diff(offsets)
    stride = WINDOW - SHARED
    count = np.where(size > 0, np.maximum(1, -(-(size - SHARED) // stride)), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * stride
    length = np.minimum(WINDOW, offsets[text + 1] - start)
    tags = np.zeros(len(data), np.int8)
    order = np.argsort(length, kind="stable")
    for lot in range(0, len(order), LOT):
        pick = order[lot : lot + LOT]
        steps = int(length[pick].max())
        at = start[pick] + np.arange(steps)[:, None]
        mask = np.arange(steps)[:, None] < length[pick]
        got = model.decode(np.where(mask, symbol[np.minimum(at, len(data))], 0), mask)
        # Of what two windows share, each has the half that is nearer to its middle.
        own = mask & ((np.arange(steps)[:, None] >= SHARED // 2) | (nth[pick] == 0)) & ((np.arange(steps)[:, None] < length[pick] - SHARED // 2) | (nth[pick] == count[text[pick]] - 1))
        tags[at[own]] = got[own]
    return tags, data, offsets


def spans_of(model: Tagger, column: pa.Array) -> list[list[tuple[int, int, str]]]:
    """For each text, ``(start, end, kind)`` of its values in bytes, in order and apart from each other."""
    tags, data, offsets = tags_of(model, column)
    edge = np.ones(len(tags) + 1, bool)
    edge[1:-1] = tags[1:] != tags[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    real = tags[begin] > 0 if len(tags) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    row = np.searchsorted(offsets, begin, side="right") - 1
    out: list[list] = [[] for _ in range(len(offsets) - 1)]
    for r, s, e in zip(row.tolist(), (begin - offsets[row]).tolist(), (end - offsets[row]).tolist()):
        kind = int(tags[offsets[r] + s])
        if out[r] and out[r][-1][1] == s:  # parts of one value: the longer part names it
            last = out[r][-1]
            out[r][-1] = (last[0], e, max(((last[1] - last[0], last[2]), (e - s, kind)))[1])
        else:
            out[r].append((s, e, kind))
    for r, spans in enumerate(out):
        if not spans:
            continue
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        kept, last = {}, 0
        for s, e, kind in spans:
            while s < e and not _PART[raw[s]] and raw[s] not in b"+(":
                s += 1
            while e > s and not _PART[raw[e - 1]]:
                e -= 1
            joint = b"._+-" if KINDS[kind - 1] == "email" else b""
            while s and s < e and (_PART[raw[s - 1]] or raw[s - 1] in joint):  # to the edges of the words at either end
                s -= 1
            while e < len(raw) and _PART[raw[e]] and s < e:
                e += 1
            figures = sum(48 <= c <= 57 for c in raw[s:e])
            real = b"@" in raw[s + 1 : e - 1] if KINDS[kind - 1] == "email" else figures >= FIGURES[KINDS[kind - 1]]
            if real and last <= s < e:
                kept[(s, e)], last = kind, e
        for (s, e), kind in list(kept.items()):
            part, found = raw[s:e], raw.find(raw[s:e])
            while found >= 0:
                if not any(a < found + len(part) and found < b for a, b in kept):
                    kept[(found, found + len(part))] = kind
                found = raw.find(part, found + 1)
        out[r] = [(s, e, KINDS[kind - 1]) for (s, e), kind in sorted(kept.items())]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Tagger:
    """:func:`train` on the lines of at most ``sample`` texts, those whose ids have the smallest hashes.

    Null and empty texts and null ids are left aside, an id that repeats counts once, and without any text the model is
    trained on values alone. Other columns don't matter.
    """
    return train([line for r in texts(docs, sample, "text") for line in r.text.split("\n") if line.strip()], steps)


def _letters(raw: bytes, spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": len(raw[:s].decode(errors="ignore")), "end": len(raw[:e].decode(errors="ignore")), "kind": k} for s, e, k in spans]


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """``doc_id, spans`` of every text with personal data; positions are characters, in order.

    Whole texts are read, whatever their length. Null and empty texts have none; rows with a null id are left out;
    repeated rows give repeated results. Of equally good paths of tags the one with the smaller tags is taken. Other
    columns don't matter; an empty table gives an empty result. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            spans = spans_of(model, b.column("text"))
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(hit)), pa.array([_letters(b.column("text")[i].as_py().encode(), spans[i]) for i in hit], kind)], ["doc_id", "spans"])

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def redact(docs: DataFrame, model: Tagger) -> DataFrame:
    """The documents with each value replaced by its kind, as ``<EMAIL>``; all other columns stay.

    Rows with a null id go; null and empty texts stay as they are; repeated rows are each redacted. Columns of any name
    and nulls in them stay; an empty table gives an empty one.
    """
    docs = docs.where(docs["doc_id"].isNotNull())
    schema = docs.schema
    documents(docs, "doc_id")  # sets the size of batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(spans_of(model, b.column("text"))):
                if spans:
                    raw, parts, last = texts[i].encode(), [], 0
                    for s, e, k in spans:
                        parts += [raw[last:s], f"<{k.upper()}>".encode()]
                        last = e
                    texts[i] = b"".join([*parts, raw[last:]]).decode(errors="ignore")
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, schema)
