"""Languages of documents and of their segments, with a confidence: Bayesian fusion of text, declared label, address suffixes and host priors.

Text likelihoods come from a word and letter-group model that is trained on a bounded sample of labelled documents; labels are
unreliable, so a second pass counts each segment under the language the first pass gave it. Host priors are grouped counts over
all documents, smoothed towards the counts of the document type and those towards the counts of the corpus. Documents are scored once,
in Arrow batches; fusion runs on narrow rows on the JVM.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..operators.hot import attach
from ..session import checkpoint, received, share, written

# The languages told apart, and how labels name them (two- and three-letter codes and names).
LANGUAGES = ("de", "en", "es", "fr", "hi", "it", "nl", "pt")
LABELS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish espanol español castellano", "fr": "fr fra fre french francais français",
    "hi": "hi hin hindi हिन्दी हिंदी", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese portugues português",
}
# Labels that say the language is not determined.
UNDETERMINED = ("und", "zxx", "mul", "mis", "xx")
# Address suffixes of countries with one main language among these.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "ie": "en", "es": "es", "mx": "es", "fr": "fr", "in": "hi", "it": "it", "nl": "nl", "pt": "pt", "br": "pt"}

SAMPLE_DOCS = 20_000  # labelled documents that the text model may be fitted on, at most
MIN_COUNT = 3  # times a word must occur in the sample to have its own likelihood
KNOWN_WORDS = 300_000  # words whose scores a task keeps
MAX_FEATURES = 200_000  # most frequent features the model keeps
MAX_HOSTS = 10_000  # hosts whose priors may be broadcast
LEAST_WORDS, LEAST_LETTERS = 5, 18  # of a segment that counts as a whole sentence
SURE = 0.95  # posterior from which a sentence shows its language
KAPPA = 50.0  # pseudo-counts of the level above in a prior
LABEL_ODDS, SUFFIX_ODDS = 4.0, 2.0  # odds a declared label or an address suffix gives its language
TEMPERATURE = 0.5  # of the text evidence, as neighbouring letter groups repeat each other

CUT = r"(?<=[.!?।…])[\"'”»)\]]*\s+|[\r\n]+|</?(?:p|br|div|li|h\d|td|tr)\b[^>]*>"
NOISE = r"<[^>]{0,200}>|https?://\S+|\S+@\S+|\b[A-Z]{2,}[_-]?\d+\b|\b\w*\d\w*\b|\w+_\w+"
WORD = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"


def declared(label: Column) -> Column:
    """The two-letter code a label names, null if it is missing, undetermined or unknown; regions and notation do not matter."""
    names = F.create_map(*[F.lit(x) for code, ns in LABELS.items() for n in ns.split() for x in (n, code)])
    return F.try_element_at(names, F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)", 1))


def _features(word: str) -> list[str]:
    w = f"^{word}$"
    return [word, *{w[i : i + 3] for i in range(len(w) - 2)}]


class TextModel:
    """Log-likelihoods per feature and language; a word's score is remembered."""

    def __init__(self, counts: dict[str, np.ndarray]):
        totals = np.ones(len(LANGUAGES))
        for c in counts.values():
            totals += c
        self.unseen = -np.log(totals * 20.0)
        self.unseen -= self.unseen.max()
        self.logs: dict[str, np.ndarray] = {}
        size = max(1, len(counts))
        mean = totals.mean()
        for f, c in counts.items():
            rate = (c * (mean / totals) + 0.05) / (mean + 0.05 * size)
            x = np.log(rate)
            self.logs[f] = x - x.mean()
        self.zero = np.zeros(len(LANGUAGES))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)))
        self.cut, self.noise, self.word = regex.compile(CUT), regex.compile(NOISE), regex.compile(WORD)

    def of_word(self, word: str) -> np.ndarray:
        own = self.logs.get(word)
        grams = [self.logs[g] for g in _features(word)[1:] if g in self.logs]
        return (own if own is not None else self.zero) + (np.mean(grams, axis=0) * (1.0 if own is not None else 2.0) if grams else self.zero)

    def row(self, word: str) -> int:
        """The row of the word in the table of scores; beyond KNOWN_WORDS the table starts anew."""
        hit = self.rows.get(word)
        if hit is None:
            if len(self.rows) >= KNOWN_WORDS:
                raise OverflowError
            hit = len(self.rows)
            if hit == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[hit] = self.of_word(word)
            self.rows[word] = hit
        return hit

    def segments(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(start, end, words) of every segment of the text that has a letter."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                out.append((at, m.start()))
            at = m.end()
        if at < len(text):
            out.append((at, len(text)))
        got = []
        for a, b in out:
            ws = self.word.findall(self.noise.sub(" ", text[a:b]).lower())
            if ws:
                got.append((a, b, ws))
        return got

    def scores(self, segments: list[list[str]]) -> np.ndarray:
        """Log-likelihoods of the segments (lists of words, none empty), a row each."""
        known = self.rows
        try:
            at = [known[w] if w in known else self.row(w) for ws in segments for w in ws]
        except OverflowError:
            if len({w for ws in segments for w in ws}) >= KNOWN_WORDS:  # more words than the table holds: each segment by itself
                return np.array([np.sum([self.of_word(w) * n for w, n in Counter(ws).items()], axis=0) for ws in segments])
            self.rows.clear()
            at = [self.row(w) for ws in segments for w in ws]
        starts = np.concatenate([[0], np.cumsum([len(ws) for ws in segments])[:-1]])
        return np.add.reduceat(self.table[at], starts, axis=0)


def _sample(docs: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """At most about `most` labelled documents, chosen by a hash of the id."""
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), declared(F.col(label)).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    n = docs.select(declared(F.col(label)).alias("l")).filter("l is not null").count()
    share_of = min(1.0, most / max(1, n))
    return own.filter(F.pmod(F.xxhash64(F.lit(23), "_id"), F.lit(1_000_000)) < int(1_000_000 * share_of))


def train(docs: DataFrame, doc_id: str, text: str, label: str, most: int = SAMPLE_DOCS, passes: int = 2) -> TextModel:
    """The text model from a bounded sample of labelled documents. An empty sample gives a model that knows nothing."""
    sample = _sample(docs, doc_id, text, label, most)
    model: TextModel | None = None
    spark = docs.sparkSession
    for _ in range(passes):
        shared = share(spark, model or TextModel({}))
        first = model is None

        def count(it: Iterator[pd.DataFrame], shared=shared, first=first) -> Iterator[pd.DataFrame]:
            own: TextModel = received(shared)
            for pdf in it:
                got: Counter = Counter()
                for t, lang in zip(pdf["_text"], pdf["_lang"], strict=True):
                    seen: dict[str, set[str]] = {}  # a text counts a word once, so that long or repetitive texts do not outweigh others
                    long = [ws for _, _, ws in own.segments(t) if len(ws) >= LEAST_WORDS]
                    guessed = [lang] * len(long) if first or not long else [LANGUAGES[k] for k in own.scores(long).argmax(axis=1)]
                    for la, ws in zip(guessed, long, strict=True):
                        seen.setdefault(la, set()).update(ws)
                    for la, words in seen.items():
                        for w in words:
                            for f in _features(w):
                                got[f, la] += 1
                yield pd.DataFrame([(f, la, n) for (f, la), n in got.items()], columns=["f", "lang", "n"])

        rows = sample.select("_text", "_lang").mapInPandas(count, "f string, lang string, n bigint")
        per = rows.groupBy("f").agg(*[F.sum(F.when(F.col("lang") == la, F.col("n")).otherwise(0)).alias(la) for la in LANGUAGES])
        per = per.withColumn("_n", sum(F.col(la) for la in LANGUAGES)).filter(F.col("_n") >= MIN_COUNT).orderBy(F.desc("_n"), "f").limit(MAX_FEATURES)
        model = TextModel({r["f"]: np.array([r[la] for la in LANGUAGES], dtype=float) for r in per.collect()})  # at most MAX_FEATURES rows
    return model


def host_priors(docs: DataFrame, host: str, kind: str, label: str) -> DataFrame:
    """(_host, _kind, prior): smoothed shares of the declared languages by host and document type, from counts over all documents."""
    lang = declared(F.col(label))
    each = docs.groupBy(F.col(host).alias("_host"), F.col(kind).alias("_kind")).agg(*[F.sum(F.when(lang == la, 1).otherwise(0)).alias(la) for la in LANGUAGES])
    every = written(each.select("_host", "_kind", F.array(*[F.col(la).cast("double") for la in LANGUAGES]).alias("n")))
    add = F.array(*[F.sum(F.col("n")[i]) for i in range(len(LANGUAGES))])
    kinds = every.groupBy(F.col("_kind").alias("_k2")).agg(add.alias("by_kind"))
    hosts = every.groupBy(F.col("_host").alias("_h2")).agg(add.alias("by_host"))
    every = attach(attach(every, kinds, {"_kind": "_k2"}, null_safe=True), hosts, {"_host": "_h2"}, null_safe=True)
    total = every.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(LANGUAGES))]).select(F.array(*[f"t{i}" for i in range(len(LANGUAGES))]).alias("all"))
    every = every.crossJoin(F.broadcast(total))  # one row

    def smooth(counts: Column, above: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, p: (c + KAPPA * p) / (n + KAPPA))

    flat = F.array(*[F.lit(1.0 / len(LANGUAGES))] * len(LANGUAGES))
    every = every.withColumn("p0", smooth(F.col("all"), flat)).withColumn("p1", smooth(F.col("by_host"), F.col("p0"))).withColumn("p1", F.zip_with("p1", smooth(F.col("by_kind"), F.col("p0")), lambda a, b: (a + b) / 2))
    return every.select("_host", "_kind", smooth(F.col("n"), F.col("p1")).alias("prior"))


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", host: str = "source", kind: str = "doc_type", model: TextModel | None = None) -> DataFrame:
    """(doc_id, label, label_missing, has_letter, segments, languages): per segment start, end, language, confidence and whether it is a sentence.

    languages are those of at least one whole sentence of posterior SURE or more; a text without any has the best language of all its
    segments together; a text without letters (null, empty and blank texts too) has none. Equal posteriors go to the first language by code.
    Priors meet the documents by a broadcast as long as there are at most MAX_HOSTS of them, else by a join on the document's id.
    """
    model = model or train(docs, doc_id, text, label)
    shared = share(docs.sparkSession, model)
    priors = checkpoint(host_priors(docs, host, kind, label))
    small = priors.limit(MAX_HOSTS + 1).count() <= MAX_HOSTS
    p = priors.select(F.col("_host").alias("_h"), F.col("_kind").alias("_kd"), "prior")
    lab = F.col(label)
    gone = is_missing(lab) | F.lower(F.trim(lab)).isin(*UNDETERMINED)
    src = docs.select(F.col(doc_id).cast("bigint").alias("_doc"), F.col(text).alias("_text"), declared(lab).alias("_label"), gone.alias("_missing"), F.col(host).alias("_host"), F.col(kind).alias("_kind"))
    if small:
        src = src.join(F.broadcast(p), F.col("_host").eqNullSafe(F.col("_h")) & F.col("_kind").eqNullSafe(F.col("_kd")), "left")
    else:  # hosts meet ids only, salted; the texts meet their priors by id, which no host can crowd
        own = attach(src.select("_doc", "_host", "_kind").distinct(), p, {"_host": "_h", "_kind": "_kd"}, null_safe=True).groupBy(F.col("_doc").alias("_d"), F.col("_host").alias("_h"), F.col("_kind").alias("_kd")).agg(F.first("prior").alias("prior"))
        src = src.join(own, (F.col("_doc") == F.col("_d")) & F.col("_host").eqNullSafe(F.col("_h")) & F.col("_kind").eqNullSafe(F.col("_kd")), "left")
    src = src.select("_doc", "_text", "_label", "_missing", "prior")
    schema = f"{doc_id} bigint, label string, label_missing boolean, has_letter boolean, segments array<struct<start:int,end:int,lang:string,confidence:double,sentence:boolean>>, languages array<string>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: TextModel = received(shared)
        address = regex.compile(r"(?:https?://|@)[\w.-]+?\.([a-z]{2})(?:[/\s,;:)>]|$)")
        letter = regex.compile(r"\p{L}")
        at = {la: i for i, la in enumerate(LANGUAGES)}
        flat = np.full(len(LANGUAGES), 1.0 / len(LANGUAGES))
        for pdf in it:
            has, found, langs = [], [], []
            for t, lab_, prior in zip(pdf["_text"], pdf["_label"], pdf["prior"], strict=True):
                t = t or ""
                has.append(letter.search(t) is not None)
                segs = own.segments(t) if has[-1] else []
                if not segs:
                    found.append([])
                    langs.append([LANGUAGES[int(np.argmax(prior if prior is not None else flat))]] if has[-1] else [])
                    continue
                lp = np.log(np.asarray(prior if prior is not None else flat, dtype=float))
                if lab_ in at:
                    lp[at[lab_]] += math.log(LABEL_ODDS)
                for la in {SUFFIXES[x] for x in address.findall(t) if x in SUFFIXES}:
                    lp[at[la]] += math.log(SUFFIX_ODDS)
                ll = own.scores([ws for _, _, ws in segs])
                post = _soft(TEMPERATURE * ll + lp)
                best, conf = post.argmax(axis=1).tolist(), post.max(axis=1).tolist()
                whole = [len(ws) >= LEAST_WORDS and sum(map(len, ws)) >= LEAST_LETTERS for _, _, ws in segs]
                found.append([{"start": a, "end": b, "lang": LANGUAGES[k], "confidence": c, "sentence": w} for (a, b, _), k, c, w in zip(segs, best, conf, whole, strict=True)])
                sure = sorted({LANGUAGES[k] for k, c, w in zip(best, conf, whole, strict=True) if w and c >= SURE})
                langs.append(sure or [LANGUAGES[int(np.argmax(TEMPERATURE * ll.sum(axis=0) + lp))]])
            yield pd.DataFrame({doc_id: pdf["_doc"], "label": pdf["_label"], "label_missing": pdf["_missing"], "has_letter": has, "segments": found, "languages": langs})

    return src.mapInPandas(run, schema)


def findings(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang): of documents with a letter, those without a label, with a wrong one, or with several languages; a row per language."""
    right = (F.size("languages") == 1) & F.coalesce(F.col("languages")[0] == F.col("label"), F.lit(False)) & ~F.col("label_missing")
    return found.filter(F.col("has_letter") & ~right).select(doc_id, F.explode("languages").alias("lang"))
