"""Languages of documents and of their paragraphs, whatever their labels say.

Method: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection.  A text is cut
into paragraphs, these into pieces of at most ``PIECE`` words (at sentence ends where
there are any).  A piece is the mean of the embeddings of its hashed character
n-grams; a linear layer and a softmax give its language.  The softmax is
calibrated on held-out pieces (one temperature), and pieces below the calibrated
threshold, or without prose, count as no language.  A paragraph has the
language of the greater part of its prose in characters, and so has a document.

Training: a sample of labelled documents, at most ``PER_LANGUAGE`` of each language
and none above ``LONGEST`` characters (parameters; drawn by hash, whole texts).  Labels are
partly wrong, so a first model relabels the pieces, and the second learns from those it is
sure of.

Calibration: held-out documents with their own labels, all pieces.  A label is taken to be
right with probability 1 - noise and else any other; temperature and noise are fitted
together by the greatest likelihood, so wrong labels do not flatten the confidence.
``Model.error`` is the expected calibration error on these pieces, label noise allowed for.
Pieces with a calibrated confidence below ``LEAST`` are rejected.

Scale.  Only the sample reaches the driver, at most 2 * PER_LANGUAGE * 6 * LONGEST
characters.  Labelling is one pass without a shuffle.  Embedding and linear layer are
multiplied out beforehand, so an n-gram costs one look-up, and equal pieces of a batch are
scored once.  Batches are cut to ``CHARS`` characters, however long texts are.

Defined cases.  Null and empty texts are ``und`` with confidence 0 and have no
paragraphs.  A document without any usable label in the whole table leaves nothing to
learn from: all are ``und``.  Doubled rows are labelled alike.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("es", "en", "pt", "fr", "de", "it")
UND = "und"
PER_LANGUAGE = 300
LONGEST = 20_000
PIECE = 14
CHARS = 1_000_000
LEAST = 0.4
#: Small samples are gone through more often, so that there are at least so many steps.
LEAST_STEPS = 400
BUCKETS, DIM, GRAMS = 1 << 15, 12, (2, 3, 4, 5)

#: What a label may say for each language, without accents, in lower case.
NAMES = {
    "es": "es spa esp spanish espanol castellano castilian espagnol spanisch spagnolo espanhol castelhano",
    "en": "en eng english ingles anglais englisch inglese",
    "pt": "pt por portuguese portugues portugais portugiesisch portoghese",
    "fr": "fr fra fre french frances francais franzosisch franzoesisch francese",
    "de": "de deu ger german aleman alemao allemand deutsch tedesco",
    "it": "it ita italian italiano italien italienisch",
    "other": "ca cat gl glg eu eus nl nld dut la lat pl pol sv swe da dan no nor fi fin ru rus zh zho ja jpn ar ara ro ron hu hun cs ces el ell tr tur catalan latin dutch",
}


def label_language(c: Column) -> Column:
    """The language a label names: one of LANGUAGES, ``other``, or null if it names none."""
    plain = F.translate(F.lower(F.trim(c)), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    first = F.regexp_extract(plain, r"^([a-z]+)(?:[-_ (.].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(*names.split()), lang).otherwise(out)
    return out


# -- text ----------------------------------------------------------------------

_BREAK = re.compile(r"\r\n|\r|\n")
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_BROKEN = re.compile("[ÂÃâ][\x80-\xbf€Œ-ƒˆ˜–-›™]")
_DROP = re.compile(r"(?<!\S)[^\s\d_@|/\\]*[\d_@|/\\]\S*")
_STOP = re.compile(r"[.!?:;]\s+")
_WORD = re.compile(r"[a-z]+")


def paragraphs(text: str) -> list[str]:
    """Runs of lines that are not blank; table rows (two or more bars) are left out of the text, not of the count."""
    out: list[str] = []
    run: list[str] = []
    for line in [*_BREAK.split(text), ""]:
        if line.strip():
            run.append("" if line.count("|") > 1 else line.strip())
        elif run:
            out.append(" ".join(run))
            run = []
    return out


def _byte(ch: str) -> bytes:
    try:
        return ch.encode("cp1252")
    except UnicodeEncodeError:
        return ch.encode("latin-1", "ignore")


def mended(s: str) -> str:
    """Markup and entities away, UTF-8 that was read as a one-byte encoding repaired."""
    if "<" in s:
        s = _TAG.sub(" ", s)
    if "&" in s:
        s = html.unescape(s)
    if _BROKEN.search(s):
        s = b"".join(map(_byte, s)).decode("utf-8", "ignore")
    return s


def plain(s: str) -> list[str]:
    """Words of lower case ASCII letters; tokens with figures are dropped."""
    s = _DROP.sub(" ", s).lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.replace("ß", "ss")).encode("ascii", "ignore").decode()
    return _WORD.findall(s)


def sentences(s: str) -> list[str]:
    """Parts after a stop behind two letters, or behind a closing bracket or quotation mark."""
    out, at = [], 0
    for m in _STOP.finditer(s):
        i = m.start()
        if i > 1 and s[i - 1].isalpha() and s[i - 2].isalpha() or i and s[i - 1] in ")]»”\"":
            out.append(s[at : i + 1])
            at = m.end()
    out.append(s[at:])
    return out


def pieces(paragraph: str) -> list[tuple[str, float]]:
    """(plain words, characters) of parts of at most PIECE words.

    The characters are those of the part before it was made plain, markup aside.  No
    parts where there is no prose: fewer than 3 words or 10 letters.
    """
    out: list[tuple[list[str], float]] = []
    letters, long = 0, 0
    for part in sentences(mended(paragraph).strip()):
        words = plain(part)
        if not words:
            continue
        letters += sum(map(len, words))
        if long < 3:
            long += sum([len(w) > 1 for w in words])
        n = -(-len(words) // PIECE)
        for i in range(n):
            w = words[i * len(words) // n : (i + 1) * len(words) // n]
            out.append((w, len(part) * len(w) / len(words)))
    if long < 3 or letters < 10:
        return []
    kept: list[tuple[list[str], float]] = []
    for p, size in out:  # a part too short to tell joins the one before it
        if kept and (len(p) < 3 or len(kept[-1][0]) < 3):
            kept[-1] = (kept[-1][0] + p, kept[-1][1] + size)
        else:
            kept.append((p, size))
    return [(" ".join(p), size) for p, size in kept]


# -- features ------------------------------------------------------------------


def hashed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length of n-grams (bucket, text) of those within words and their edges, in the order of the texts."""
    if not texts:
        return []
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("ascii", "replace"), np.uint8)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letter = raw != 32
    out = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[1 : 1 + m] if n == 2 else np.ones(m, bool)
        for j in range(1, n - 1):
            ok = ok & letter[j : j + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint32)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * np.uint32(0x01000193) ^ raw[at + j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
        out.append((h & np.uint32(BUCKETS - 1), of[at]))
    return out


# -- model ---------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """``table``: embedding times linear layer, a row per bucket; pieces below ``least`` are rejected.

    ``noise``: share of wrong labels among the held-out pieces; ``error``: expected calibration error there.
    """

    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    noise: float = 0.0
    error: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities per language; equal texts are scored once."""
        at: dict[str, int] = {}
        where = np.array([at.setdefault(t, len(at)) for t in texts], np.int64)
        own = list(at)
        z = np.zeros((len(own), len(LANGUAGES)))
        n = np.zeros(len(own))
        for h, of in hashed(own):
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            if len(begin):
                z[of[begin]] += np.add.reduceat(self.table[h], begin, axis=0)
                n += np.bincount(of, minlength=len(own))
        return _softmax((z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)[where]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sgd(texts: list[str], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int, batch: int = 64, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times linear layer, and bias, by stochastic gradient descent."""
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin = rng.normal(0, 0.3, (DIM, len(LANGUAGES))).astype(np.float32)
    bias = np.zeros(len(LANGUAGES), np.float32)
    h, of = (np.concatenate(x) for x in zip(*hashed(texts), strict=True))
    h = h.astype(np.int64)
    order = np.argsort(of, kind="stable")
    h, n = h[order], np.bincount(of, minlength=len(texts))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
    begin = np.concatenate([[0], np.cumsum(n)])
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        perm = rng.permutation(len(texts))
        for i in range(0, len(perm), batch):
            lr = rate * (1 - step / steps)
            step += 1
            rows = perm[i : i + batch]
            rows = rows[n[rows] > 0]
            size = n[rows]
            at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            g, seg = h[at], np.repeat(np.arange(len(rows)), size)
            x = np.add.reduceat(emb[g], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
            p = _softmax(x @ lin + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None]
            dx = (p @ lin.T) * (lr * 12.0 / size)[:, None]
            lin -= lr * (x.T @ p) / len(rows) * 4
            bias -= lr * p.mean(0) * 0.5
            uniq, inv = np.unique(g, return_inverse=True)
            step_e = np.stack([np.bincount(inv, dx[seg, k], len(uniq)) for k in range(DIM)], 1)
            emb[uniq] -= step_e.astype(np.float32)
    return (emb @ lin).astype(np.float64), bias.astype(np.float64)


def train(samples: list[tuple[str, str]], seed: int = 42, epochs: int = 3) -> Model | None:
    """A model from (text, language) of labelled documents; None if there is nothing to learn from."""
    texts, y, doc = [], [], []
    for d, (text, lang) in enumerate(samples):
        for p in paragraphs(text or ""):
            for q, _ in pieces(p):
                texts.append(q), y.append(LANGUAGES.index(lang)), doc.append(d)
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    y, doc = np.array(y), np.array(doc)
    share = np.bincount(y, minlength=len(LANGUAGES))
    weight = (len(y) / len(LANGUAGES) / np.maximum(share, 1))[y].clip(0.2, 5).astype(np.float32)
    held = rng.permutation(len(samples))[: max(1, len(samples) // 5)]
    held = np.isin(doc, held)
    first = Model(*_sgd([t for t, h in zip(texts, held, strict=True) if not h], y[~held], weight[~held], rng, 2), 1.0, 0.0)
    p = first.scores(texts)
    said = y
    sure, y = p.max(1) > 0.6, p.argmax(1)  # wrong labels and foreign paragraphs get the language they are in
    use = np.flatnonzero(sure & ~held)
    table, bias = _sgd([texts[i] for i in use], y[use], weight[use], rng, epochs)
    check = np.flatnonzero(held)
    if not len(check):
        return Model(table, bias, 1.0, LEAST)
    z = np.log(np.maximum(Model(table, bias, 1.0, 0.0).scores([texts[i] for i in check]), 1e-30))
    t, noise, error = calibrated(z, said[check])
    return Model(table, bias, t, LEAST, noise, error)


def calibrated(z: np.ndarray, said: np.ndarray, bins: int = 10) -> tuple[float, float, float]:
    """Temperature, share of wrong labels and expected calibration error for scores and partly wrong labels."""
    k, row = z.shape[1], np.arange(len(z))
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.1, 5, 60):
        own = _softmax(z / t)[row, said]
        for noise in np.linspace(0, 0.5, 51):
            loss = -np.log(np.maximum((1 - noise) * own + noise * (1 - own) / (k - 1), 1e-12)).mean()
            if loss < best[0] - 1e-9:
                best = (loss, float(t), float(noise))
    _, t, noise = best
    p = _softmax(z / t)
    top, hit = p.max(1), p.argmax(1) == said
    said_too = (1 - noise) * top + noise * (1 - top) / (k - 1)  # how often a label should agree
    of = np.minimum((top * bins).astype(int), bins - 1)
    error = sum(abs(hit[of == b].mean() - said_too[of == b].mean()) * (of == b).mean() for b in range(bins) if (of == b).any())
    return t, noise, float(error)


# -- operator ------------------------------------------------------------------


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST, seed: int = 42) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language, never twice as many, by hash: (text, language).

    The counts read only the labels; texts above ``longest`` characters are not learnt from.
    """
    t = docs.where(F.col("label").isin(*LANGUAGES))
    n = {r["label"]: r["n"] for r in t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return []
    part = F.lit(0.0)
    for lang, k in n.items():
        part = F.when(F.col("label") == lang, F.lit(min(1.0, per_language / k))).otherwise(part)
    h = F.xxhash64(F.lit(seed), "doc_id")
    u = F.pmod(h, F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = t.where((u < part) & (F.length("text") <= longest)).select(h.alias("h"), "doc_id", "text", "label").limit(2 * per_language * len(LANGUAGES)).collect()
    rows.sort(key=lambda r: (r["h"], str(r["doc_id"])))
    return [(r["text"], r["label"]) for r in rows]


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, label, segment_no, lang_code, confidence, chars, mixed) for (doc_id, text, label).

    Segment 0 is the document, 1, 2, ... are its paragraphs.  ``mixed``: the document's
    paragraphs are in more than one language.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the data

    def decide(of: np.ndarray, size: np.ndarray, lang: np.ndarray, prob: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language with the most characters per unit, its confidence, its characters; -1 for none."""
        k = len(LANGUAGES)
        ok = lang >= 0
        letters = np.bincount(of[ok] * k + lang[ok], size[ok], n * k).reshape(n, k)
        mass = np.bincount(of[ok] * k + lang[ok], (size * prob)[ok], n * k).reshape(n, k)
        best = letters.argmax(1)
        total = np.bincount(of, size, n)
        row = np.arange(n)
        top = letters[row, best]
        return np.where(top > 0, best, -1), mass[row, best] / np.maximum(total, 1e-9), top

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model | None = broadcast.value
        for f in frames:
            chars = f["text"].map(lambda x: 0 if x is None else len(x)).to_numpy()
            cut = np.flatnonzero(np.diff(np.cumsum(chars) // CHARS)) + 1
            for part in np.split(np.arange(len(f)), cut):
                g = f.iloc[part]
                texts: list[str] = []
                size: list[float] = []
                para: list[int] = []
                doc_of: list[int] = []  # of each paragraph
                no: list[int] = []
                for d, text in enumerate(g["text"]):
                    for i, p in enumerate(paragraphs(text) if text else ()):
                        q = pieces(p) if m else []
                        texts += [x for x, _ in q]
                        size += [x for _, x in q]
                        para += [len(doc_of)] * len(q)
                        doc_of.append(d), no.append(i + 1)
                score = m.scores(texts) if m else np.zeros((0, len(LANGUAGES)))
                prob, lang = (score.max(1), score.argmax(1)) if len(texts) else (np.zeros(0), np.zeros(0, int))
                lang = np.where(prob >= m.least, lang, -1) if m else lang
                weight = np.array(size, float)
                para_a, doc_a, n = np.array(para, int), np.array(doc_of, int), len(g)
                pl, pc, pn = decide(para_a, weight, lang, prob, len(doc_of))
                dl, dc, dn = decide(doc_a[para_a] if len(para_a) else para_a, weight, lang, prob, n)
                kinds = np.zeros((n, len(LANGUAGES)), bool)
                kinds[doc_a[pl >= 0], pl[pl >= 0]] = True
                mixed = kinds.sum(1) > 1
                code = np.array([*LANGUAGES, UND], object)  # -1 is the last
                at = np.concatenate([np.arange(n), doc_a])
                yield pd.DataFrame({"doc_id": g["doc_id"].to_numpy()[at], "label": g["label"].to_numpy()[at], "segment_no": np.concatenate([np.zeros(n, int), no]).astype(np.int32), "lang_code": code[np.concatenate([dl, pl])], "confidence": np.concatenate([dc, pc]), "chars": np.concatenate([dn, pn]).round().astype(np.int64), "mixed": mixed[at]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "label").mapInPandas(run, f"doc_id {kind}, label string, segment_no int, lang_code string, confidence double, chars long, mixed boolean")
