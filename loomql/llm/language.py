"""Language identification of pages and documents by Bayesian evidence fusion.

The posterior of a language multiplies four kinds of evidence: the likelihood of the visible text, that of the language declared
in the markup, that of the address suffix, and a prior for the host. The prior is smoothed
hierarchically: a host leans on its registered domain, a domain on all pages. The tables come from
grouped aggregation over all pages, weighted by what each page's own text says; a page's own weight is
taken out again before its host's prior applies to it. A document has no markup and no address; its source is its host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fitting_rows, written

#: The most labelled documents that the text model is fitted on, and its table's cells for byte trigrams.
SAMPLE, CELLS = 3000, 1 << 14
#: The most bytes of their texts.
TEXTS = 64 << 20
#: Trigrams count as independent up to about this many; a longer text says no more than that.
EVIDENCE = 60.0
#: Added to counts of declared languages and suffixes; rows that a level of the hierarchy weighs in the one below.
ADDED, HOST_WEIGHT, DOMAIN_WEIGHT = 0.5, 4.0, 8.0
#: Letters in lower case, other ASCII as spaces; bytes of longer characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Elements whose content isn't shown. One without an end hides the rest of the page, as browsers have it.
UNSEEN = re.compile(r"(?i)<(script|style|template|noscript)(?=[\s/>])")
#: Where a tag or a comment begins; any other "<" is text.
OPENING = re.compile(r"<(?=[A-Za-z/!?])")
DECLARED = re.compile(r"""(?i)(?<![\w-])lang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""")
#: Suffixes of two labels under which domains are registered: fixed values, the common ones.
SECOND_LEVEL = frozenset(
    "ac.at ac.jp ac.kr ac.nz ac.uk ac.za co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.bd com.br com.cn com.co com.eg com.hk "
    "com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.ve com.vn edu.au edu.br edu.cn edu.tw go.jp go.kr gob.ar gob.mx gov.au "
    "gov.br gov.cn gov.in gov.uk govt.nz ltd.uk me.uk ne.jp net.au net.br net.cn net.nz net.uk or.at or.jp or.kr org.ar org.au org.br org.cn org.mx org.nz org.tr org.uk org.za".split()
)
HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def trigrams(text: str) -> np.ndarray:
    """Cells of a text's byte trigrams, those of blanks alone left out."""
    b = np.frombuffer(re.sub(rb" +", b" ", b" " + text.encode().translate(LETTERS) + b" "), np.uint8).astype(np.uint32)
    return ((b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(2654435761)) >> np.uint32(18) if len(b) > 2 else np.empty(0, np.uint32)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each cell in each."""
    names = sorted(set(langs))
    counts = np.full((len(names), CELLS), 0.1)
    for text, lang in zip(texts, langs, strict=True):
        counts[names.index(lang)] += np.bincount(trigrams(text), minlength=CELLS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fit on at most ``sample`` documents with a language, those whose doc_id hashes lowest, of at most ``TEXTS`` bytes together.

    Only their identifiers are broadcast. Of rows that share an identifier one is fitted on.
    """
    known = docs.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = fitting_rows(known.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", "text", TEXTS)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def tags(page: str) -> Iterator[tuple[int, int]]:
    """The (begin, end) of what isn't shown: tags, comments, and elements of ``UNSEEN`` with their content, in one pass over the page.

    What has no end reaches to the page's end. Each search begins where the last ended, and an end that wasn't found is not
    looked for again, so the work grows with the page's length whatever is in it.
    """
    low, size = None, len(page)
    first = OPENING.search(page)
    while first:
        at = first.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else size
        elif found := UNSEEN.match(page, at):
            low = low if low is not None else page.lower()
            # Lower case may lengthen a few letters; then the end is looked for letter by letter in the page itself.
            if len(low) == size:
                close = low.find(f"</{found[1].lower()}", at)
            else:
                hit = re.compile(f"(?i)</{found[1]}").search(page, at)
                close = hit.start() if hit else -1
            end = page.find(">", close) if close >= 0 else -1
            end = end + 1 if end >= 0 else size
        else:
            end = page.find(">", at + 1)
            end = end + 1 if end >= 0 else size
        yield at, end
        first = OPENING.search(page, end)


def page_parts(url: str | None, page: str | None) -> tuple[str, str, str]:
    """Host (lower case, may be empty), language declared in the first html tag ("none" without), visible text."""
    found = HOST.match(url or "")
    host = found[1].lower().rstrip(".") if found else ""
    page, shown, last, lang = page or "", [], 0, None
    for begin, end in tags(page):
        shown.append(page[last:begin])
        last = end
        if lang is None and page[begin + 1 : begin + 5].lower() == "html" and not page[begin + 5 : begin + 6].isalnum():
            declared = DECLARED.search(page, begin, end)
            lang = declared[1].lower() if declared else "none"
    shown.append(page[last:])
    return host, lang or "none", html.unescape(" ".join(shown))


def document_parts(source: str | None, text: str | None) -> tuple[str, str, str]:
    """The same of a document, whose source is its host."""
    return source or "", "none", text or ""


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, url_col: str, html_col: str, parts: Callable) -> DataFrame:
    """(id, host, domain, suffix, declared, w0, w1, ...): what each page's own text says, as logs that need no common total."""
    names, table = model
    kind = pages.schema[id_col].dataType.simpleString()
    shown = [f"w{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, declared, logs = [], [], []
            for url, page in zip(batch.column(1), batch.column(2), strict=True):
                host, lang, text = parts(url.as_py(), page.as_py())
                cells = trigrams(text)
                total = table @ np.bincount(cells, minlength=CELLS)
                logs.append((total - total.max()) * min(1.0, EVIDENCE / max(1, len(cells))))
                hosts.append(host)
                declared.append(lang)
            w = np.array(logs).reshape(-1, len(names))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "host": pa.array(hosts, pa.string()), "declared": pa.array(declared, pa.string())} | {c: w[:, i].copy() for i, c in enumerate(shown)})

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, f"id {kind}, host string, declared string, {', '.join(f'{c} double' for c in shown)}")
    labels = F.split("host", r"\.")
    last = F.element_at(labels, -1)
    ending = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    domain = F.when(ending(2).isin(*sorted(SECOND_LEVEL)), ending(3)).otherwise(ending(2))
    return rows.withColumns({"domain": domain, "suffix": F.when(F.size(labels) > 1, last).otherwise("")})


def shares(logs: list[Column]) -> list[Column]:
    """Probabilities from logs."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: Callable = page_parts) -> DataFrame:
    """One row for each page: id, lang, probability, text_lang (by the text alone), declared, host.

    ``model`` is what ``train`` gives, ``parts`` takes a row's address and content apart. Languages are those of the fitting documents; without any, lang is null. A null or empty page has no text evidence and goes by the
    rest, ties to the first language in order. A null or odd address has an empty host, which is a host like any other. Rows stand
    alone, repeated or not; other columns play no part.
    """
    names, _ = model
    none = F.lit(None).cast("string")
    if not names:
        return pages.select(id_col, none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    rows = written(evidence(pages, model, id_col, url_col, html_col, parts), "evidence")
    n = range(len(names))
    p = [f"p{i}" for i in n]
    rows = rows.withColumns(dict(zip(p, shares([F.col(f"w{i}") for i in n]), strict=True)))
    total = rows.agg(*[F.sum(c).alias(c) for c in p]).first()
    total = [float(total[c] or 0) + ADDED for c in p]
    overall = [x / sum(total) for x in total]

    def likelihoods(key: str, prefix: str) -> DataFrame:
        """log P(value | language). Values are few, but nothing bounds them: Spark broadcasts them if they are small enough."""
        found = written(rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in p]), key)
        return found.select(key, *[F.log((F.col(p[i]) + ADDED) / total[i]).alias(f"{prefix}{i}") for i in n])

    host = rows.groupBy("host", "domain").agg(F.count("*").cast("double").alias("h"), *[F.sum(p[i]).alias(f"h{i}") for i in n])
    domain = host.groupBy("domain").agg(F.sum("h").alias("d"), *[F.sum(f"h{i}").alias(f"d{i}") for i in n])
    priors = host.join(domain, "domain").drop("domain")
    fused = rows.join(priors, "host").join(likelihoods("declared", "m"), "declared").join(likelihoods("suffix", "s"), "suffix")
    logs = []
    for i in n:  # counts without the page itself
        of_domain = (F.col(f"d{i}") - F.col(p[i]) + DOMAIN_WEIGHT * overall[i]) / (F.col("d") - 1 + DOMAIN_WEIGHT)
        of_host = (F.col(f"h{i}") - F.col(p[i]) + HOST_WEIGHT * of_domain) / (F.col("h") - 1 + HOST_WEIGHT)
        logs.append(F.col(f"w{i}") + F.col(f"m{i}") + F.col(f"s{i}") + F.log(F.greatest(of_host, F.lit(1e-9))))
    best = lambda cols: F.element_at(F.array(*map(F.lit, names)), F.array_position(F.array(*cols), F.array_max(F.array(*cols))).cast("int"))
    fused = fused.withColumns({f"q{i}": x for i, x in enumerate(shares(logs))})
    q = [F.col(f"q{i}") for i in n]
    return fused.select(F.col("id").alias(id_col), best(q).alias("lang"), F.array_max(F.array(*q)).alias("probability"), best([F.col(c) for c in p]).alias("text_lang"), "declared", "host")


def identify_all(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document and every page, by one text model: doc_id or page_id (the other null) and ``identify``'s columns.

    Nulls, repeats, empty texts, ties and empty tables are as in ``identify``; the model is fitted on the documents' own labels.
    """
    model = train(docs)
    of_docs = identify(docs, model, "doc_id", "source", "text", document_parts).withColumn("page_id", F.lit(None).cast(pages.schema["page_id"].dataType))
    of_pages = identify(pages, model).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return of_docs.unionByName(of_pages).select("doc_id", "page_id", "lang", "probability", "text_lang", "declared", "host")
