"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a block of lines without a blank one between. Its units are the block, its lines, the sentences up to a
licence's name, and the runs of words that hold most of a licence text's words, over lines or inside one; marks of
comments don't count as words. A unit's word and word-pair hashes are the sparse features of a logistic regression over
licence families and an unknown class. It is fitted on notices made from forms and names and on licence texts, whole
and damaged, against paragraphs of a bounded sample of the documents, notices of other licences, and sentences that only
talk of licences; a temperature fitted on examples left out calibrates its probabilities. A prediction is confirmed by
comparison with the templates: a notice must have the family's whole name after words that grant something and nothing that
denies it, and a licence text most of the template's words in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import DENIALS, FORMS, GRANTS, NAMES, OTHER_NAMES, TALK, TEXTS
from .shared import fitting_rows

CELLS = 1 << 15
#: The most documents whose paragraphs are fitted on as unknown and the most bytes of them, the damaged forms made of each text, the forms of notice drawn for each name, and passes.
SAMPLE, BYTES, TEXT_FORMS, NOTICE_FORMS, EPOCHS = 400, 8 << 20, 10, 10, 8
#: Least probability of a prediction, and least share of a licence text's words, in order, that confirms it.
SURE, ALIKE = 0.5, 0.8
#: Words of a sentence before a name that are looked at; words before a granting one that may deny it; words beside a name in a heading.
REACH, BEFORE, HEADING = 16, 4, 3
VOCABULARY = 1 << 19
#: ASCII's bytes that are neither letters nor digits.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NAMES]
#: Identifiers too short to be a name by themselves.
SPDX = {"MIT": "MIT", "ISC": "ISC", "Zlib": "Zlib", "PostgreSQL": "PostgreSQL"}


def plain(raw: str) -> str:
    """Letters and digits in lower case, British licences as American ones."""
    return "".join(c for c in raw.lower() if c.isalnum()).replace("licence", "license")


def plain_bytes(raw: bytes) -> bytes:
    """``plain`` of a word in UTF-8, in UTF-8."""
    if raw.isascii():
        return raw.lower().translate(None, MARKS).replace(b"licence", b"license")
    return plain(raw.decode("utf-8", "replace")).encode()


def hashed(word: str | bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


class Words(dict):
    """Raw word to the hash of its letters and digits; 0 if it has none."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        word = plain_bytes(raw)
        h = self[raw] = hashed(word) if word else 0
        return h


def cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of words and of pairs of words that follow one another (the last word's pair isn't used)."""
    pair = h * np.uint64(0x9E3779B97F4A7C15)
    pair[:-1] += h[1:]
    fold = lambda x: ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)
    return fold(h), fold(pair)


def word_hashes(words: Words, text: bytes) -> np.ndarray:
    h = np.fromiter(map(words.__getitem__, text.split()), np.uint64)
    return h[h > 0]


def found_in(values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, its place in sorted values that aren't empty, and whether it is there."""
    at = np.searchsorted(values, h).clip(max=len(values) - 1)
    return at, values[at] == h


def features(h: np.ndarray) -> np.ndarray:
    one, two = cells(h)
    return np.unique(np.concatenate((one, two[:-1])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def forms(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text, and it with words around it or with a word lost, at random."""
    words, out = text.split(), [text]
    noise = ["(c)", "2019", "Copyright", "Example", "Authors", "file", "README", "see", "LICENSE", "for", "details."]
    for _ in range(n - 1):
        w = [x for x in words if rng.random() > 0.06] or words
        before, after = (list(rng.choice(noise, rng.integers(0, 4))) for _ in range(2))
        out.append(" ".join([*before, *w, *after]))
    return out


def names() -> list[tuple[str, str]]:
    """(family, name) of all names."""
    return [(f, n) for f, ns in NAMES.items() for n in ns] + [(f, f"SPDX-License-Identifier: {n}") for n, f in SPDX.items()]


def examples(unknown: list[str], seed: int = 3) -> list[tuple[str, int]]:
    """Made examples with their labels; 0 is unknown."""
    rng, out = np.random.default_rng(seed), []
    for family, name in names():
        label = FAMILIES.index(family)
        drawn = rng.choice(FORMS, NOTICE_FORMS, replace=False) if "SPDX" not in name else ["{} ", "{} int main"]
        made = [name, f"The {name}", *(f.format(name) for f in drawn)]
        out += [(x, label) for m in made for x in forms(m, rng, 2)]
    for family, texts in TEXTS.items():
        out += [(x, FAMILIES.index(family)) for t in texts for x in forms(t, rng, TEXT_FORMS)]
    out += [(x, 0) for n in OTHER_NAMES for f in FORMS for x in forms(f.format(n), rng, 2)]
    return out + [(t, 0) for t in [*TALK * 8, *unknown]]


def fit(unknown: list[str], seed: int = 3) -> dict:
    """Weights, a temperature, and the templates' word hashes. A third of the examples only set the temperature."""
    rng, words = np.random.default_rng(seed), Words()
    texts = [(FAMILIES.index(f), word_hashes(words, t.encode())) for f, ts in TEXTS.items() for t in ts]
    called = [(FAMILIES.index(f), word_hashes(words, n.encode())) for f, n in names()]
    model = {"texts": texts, "known": [np.unique(t) for _, t in texts], "names": {}, "anchors": np.unique([n[0] for _, n in called])}
    for family, n in called:
        model["names"].setdefault(int(n[0]), []).append((tuple(n.tolist()), family))
    model["vocabulary"] = np.unique(np.concatenate(model["known"]))
    model["holds"] = np.array([np.isin(model["vocabulary"], t) for t in model["known"]], np.float32)
    for found in model["names"].values():
        found.sort(key=lambda x: -len(x[0]))
    rows: list[tuple[np.ndarray, int]] = []
    for text, label in examples(unknown, seed):
        h = word_hashes(words, text.encode())
        if len(h) and (label or not named(model, h) and not runs(model, h)):  # a paragraph that holds a name or a text may be a licence
            rows.append((features(h), label))
    order = rng.permutation(len(rows))
    held, used = order[::3], np.setdiff1d(order, order[::3])
    w, c = np.zeros((CELLS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES))
    for epoch in range(EPOCHS):
        rate = 1 / (1 + 0.5 * epoch)
        for i in rng.permutation(used):
            f, label = rows[i]
            x = 1 / np.sqrt(len(f))
            d = softmax(w[f].sum(axis=0) * x + c)
            d[label] -= 1
            w[f] -= rate * x * d + rate * 1e-4 * w[f]
            c -= rate * 0.1 * d
    logits = np.array([w[rows[i][0]].sum(axis=0) / np.sqrt(len(rows[i][0])) + c for i in held])
    labels = np.array([rows[i][1] for i in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    return model | {"w": w, "c": c, "heat": min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)}


def predict(model: dict, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Family and calibrated probability of each paragraph, given its word hashes (none may be empty)."""
    sizes = np.array([len(h) for h in lines])
    flat = np.concatenate(lines)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row = np.repeat(np.arange(len(lines)), sizes)
    one, two = cells(flat)
    inner = np.ones(len(flat), bool)
    inner[first[1:] - 1] = False
    inner[-1] = False
    keys = np.concatenate((row * CELLS + one, (row * CELLS + two)[inner]))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]  # a feature counts once
    row = keys // CELLS
    begin = np.searchsorted(row, np.arange(len(lines)))
    total = np.add.reduceat(model["w"].take(keys % CELLS, axis=0), begin, axis=0)
    p = softmax((total / np.sqrt(np.bincount(row, minlength=len(lines)))[:, None] + model["c"]) / model["heat"])
    return p.argmax(axis=1), p.max(axis=1)


# Templates


def in_order(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a bit for each place of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    left = full = (1 << len(a)) - 1
    for y in b:
        u = left & masks.get(y, 0)
        left = (left + u | left - u) & full
    return len(a) - left.bit_count()


def likeness(model: dict, h: np.ndarray, family: int) -> float:
    """The largest share of a licence text's words that the unit has in their order, over the family's texts."""
    return max((in_order(t.tolist(), h.tolist()) / len(t) for of, t in model["texts"] if of == family), default=0.0)


def likely(model: dict, h: np.ndarray) -> np.ndarray:
    """For each licence text, whether ``ALIKE`` of its distinct words are there, in whatever order."""
    at, found = found_in(model["vocabulary"], h)
    there = np.zeros(len(model["vocabulary"]), np.float32)
    there[at[found]] = 1
    return model["holds"] @ there >= ALIKE * model["holds"].sum(axis=1) - 1e-4


def runs(model: dict, h: np.ndarray) -> list[tuple[int, int]]:
    """The (first, end) of runs of a block's word hashes with ``ALIKE`` of a licence text's distinct words; none overlap for one text."""
    out = set()
    for (_, text), t, there in zip(model["texts"], model["known"], likely(model, h), strict=True):
        if not there:
            continue
        wide = len(text) + len(text) // 8 + 2  # room for a few other words
        hits, cover = [np.flatnonzero(h == w) for w in t], np.zeros(len(h), np.int64)
        for at in hits:
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, np.maximum(at - wide + 1, 0), 1)
            np.add.at(step, at + 1, -1)
            cover += np.cumsum(step[:-1]) > 0
        places = np.sort(np.concatenate(hits))
        while cover.max() / len(t) >= ALIKE:
            i = int(cover.argmax())
            inside = places[(places >= i) & (places < i + wide)]
            out.add((int(inside[0]), int(inside[-1]) + 1))
            cover[max(0, i - wide + 1) : i + wide] = 0
    return sorted(out)


def named(model: dict, h: np.ndarray) -> list[tuple[int, int, int]]:
    """The (first, end, family) of names in a block's word hashes: the longest at a place, and none inside another."""
    out, end = [], 0
    for i in np.flatnonzero(found_in(model["anchors"], h)[1]).tolist():
        for name, family in model["names"][int(h[i])]:
            if i + len(name) > end and tuple(h[i : i + len(name)].tolist()) == name:
                if i >= end:
                    out.append((i, i + len(name), family))
                    end = i + len(name)
                break
    return out


GRANT_HASHES, DENIAL_HASHES = ({hashed(plain(w)) for w in ws} for ws in (GRANTS, DENIALS))
BY_ITSELF = hashed("spdxlicenseidentifier")


def notices(model: dict, block: list[tuple[int, bool]]) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(words, family, whether it grants) of each name in a block of (word hash, whether a sentence ends there)."""
    h = np.array([x for x, _ in block], np.uint64)
    found = named(model, h)
    taken = np.zeros(len(h), bool)
    for a, b, _ in found:
        taken[a:b] = True
    for a, b, family in found:
        begin = a
        while begin > 0 and a - begin < REACH and not block[begin - 1][1]:
            begin -= 1
        stop = b
        while stop < len(block) and stop - b < HEADING and not block[stop - 1][1] and not taken[stop]:
            stop += 1
        before = h[begin:a].tolist()
        grants = [i for i, x in enumerate(before) if x in GRANT_HASHES and not taken[begin + i]]
        at = np.arange(begin + grants[-1] if grants else begin, b)
        own = h[at[~taken[at] | (at >= a)]]  # from the granting word on, without other names
        denied = any(x in DENIAL_HASHES for x in before[max(0, grants[-1] - BEFORE) if grants else 0 :])
        heading = len(h) - (b - a) <= HEADING or not before and (stop == b or block[b - 1][1])
        yield own, family, not denied and bool(grants or heading or int(h[a]) == BY_ITSELF)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit with the lines of at most ``sample`` documents as unknown: those whose identifiers hash lowest, of at most ``BYTES`` bytes together."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    chosen = known.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    rows = fitting_rows(known.join(F.broadcast(chosen), "id", "left_semi"), "id", "text", BYTES)
    texts = sorted({line for r in rows for line in r["text"].split("\n") if line.strip()})
    rng = np.random.default_rng(1)
    return fit([texts[i] for i in sorted(rng.permutation(len(texts))[: 8 * sample])])


def blocks(text: bytes) -> list[list[bytes]]:
    """The lines of each paragraph."""
    out, blank = [], True
    for line in text.split(b"\n"):
        if line.strip():
            if blank:
                out.append([])
            out[-1].append(line)
        blank = not line.strip()
    return out


def marked_words(words: Words, lines: list[bytes]) -> list[tuple[int, bool]]:
    """(word hash, whether a sentence ends there) of a block."""
    out: list[tuple[int, bool]] = []
    for raw in b" ".join(lines).split():
        ends = raw.rstrip(b"\"')*_")[-1:] in (b".", b"!", b"?", b";")
        if h := words[raw]:
            out.append((h, ends))
        elif ends and out:
            out[-1] = (out[-1][0], True)
    return out


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """A row for each input row: id, n_paragraphs, and findings: (paragraph from 0, family, probability, likeness, confirmed).

    A paragraph has one finding of a family at most: its confirmed one of the highest probability, else its likeliest. In a paragraph with
    a confirmed finding only whole names are reported besides, as single lines of a text are like those of others. Whole texts are read. A null or empty text has no paragraphs. Rows stand alone; other columns play no part. No rows give no rows.
    """
    model = model or train(docs, SAMPLE, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            counts, found, held, places, size = [], [], [], [], 0

            def settle() -> None:
                family, sure = predict(model, held)
                for j in np.flatnonzero((family > 0) & (sure >= SURE)):
                    doc, paragraph, confirms = places[j]
                    f = int(family[j])
                    alike, good = confirms(f)
                    best = (good, float(sure[j]), alike)
                    if best > found[doc].get((paragraph, f), (False, 0.0, 0.0)):
                        found[doc][paragraph, f] = best
                held.clear()
                places.clear()

            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found.append({})
                paragraphs = blocks(text.as_py() or b"")
                counts.append(len(paragraphs))
                lines = [[word_hashes(words, line) for line in p] for p in paragraphs]
                whole = np.concatenate([h for p in lines for h in p]) if lines else np.empty(0, np.uint64)
                calls, holds_text = bool(found_in(model["anchors"], whole)[1].any()), bool(len(whole)) and bool(likely(model, whole).any())
                for n, (raw, parts) in enumerate(zip(paragraphs, lines, strict=True)):
                    flat = np.concatenate(parts)
                    # Lines and blocks are predicted; only what names a licence or holds a text can be confirmed.
                    units = [(h, lambda f, h=h: (likeness(model, h, f), False)) for h in (parts if len(parts) == 1 else [*parts, flat])]
                    if calls:
                        units += [(h, lambda f, of=of, good=good: (1.0, good and f == of)) for h, of, good in notices(model, marked_words(words, raw))]
                    if holds_text:
                        spans = [flat[a:b] for a, b in runs(model, flat)]
                        units += [(h, lambda f, h=h: (likeness(model, h, f), likeness(model, h, f) >= ALIKE)) for h in spans]
                    for h, confirms in units:
                        if len(h):
                            held.append(h)
                            places.append((i, n, confirms))
                            size += len(h)
                    if size >= 100_000:
                        settle()
                        size = 0
            if held:
                settle()
            sound = [{p for (p, _), (good, *_) in x.items() if good} for x in found]
            out = [[(p, FAMILIES[f], sure, alike, good) for (p, f), (good, sure, alike) in sorted(x.items()) if good or alike == 1 or p not in has] for x, has in zip(found, sound, strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_paragraphs": pa.array(counts, pa.int64()), "findings": pa.array(out, shape)})

    schema = f"id {kind}, n_paragraphs long, findings array<struct<paragraph:long, family:string, probability:double, likeness:double, confirmed:boolean>>"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, licence (the likeliest confirmed family, ties to the first in the text; null if none), probability, families (all confirmed, sorted, joined by commas), n_confirmed, n_unconfirmed.

    Nulls, empty texts and repeats are as in ``findings``.
    """
    rows = findings(docs, id_col, text_col)
    good = F.filter("findings", lambda x: x["confirmed"])
    top = F.array_max(F.transform(good, lambda x: F.struct(x["probability"].alias("p"), (-x["paragraph"]).alias("at"), x["family"].alias("family"))))
    return rows.select(
        id_col,
        top["family"].alias("licence"),
        top["p"].alias("probability"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))), ",").alias("families"),
        F.size(good).cast("long").alias("n_confirmed"),
        (F.size("findings") - F.size(good)).cast("long").alias("n_unconfirmed"),
    )
