"""Reading level of documents: a Rasch-style model of document level and word occurrence difficulty.

Every document has a latent level and every item (a word, or a sentence of some
length) a difficulty: the higher a document's level, the likelier are
occurrences of difficult items, so that the sum of difficulties over its
occurrences is all that its level depends on. Human readers' ratings are
ordered responses to the level. Levels and difficulties are estimated in turn
over distributed tables, from all documents; ratings anchor the scale.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import store, store_bucketed

# The published Flesch-Kincaid weights (years of schooling), to which levels are linked before ratings speak, and the level bounds.
PER_SYLLABLE = 11.8
PER_SENTENCE_WORD = 0.39
ORIGIN = -15.59
BOUNDS = (4.0, 8.5, 14.0)

# Frequent function words of English and of some other languages, the classifier's first counts.
ENGLISH = frozenset("the a an each every our this that these those and or but of to in on for with from by at as is are was were be been it its we they he she you not no so if when while because which who whose will would can could has have had do does did than then there their them into under over after before between through whenever although whereas".split())
OTHERS = frozenset("der die das und ist nicht ein eine einen dem den des mit von zu auf für im am bei nach vor le la les un une et est pas des du de en dans pour sur avec que qui el los las una y es no del por con para se al lo".split())

_HEADER = re.compile(r"^(?:commit|From) [0-9a-fA-F]{7,64}\b")
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)*|Changed files|Merge|Date): \S|^\(cherry picked from commit ")
_TRACE = re.compile(r"^\s*(?:at \S+ \(\S+:\d+\)|File \"[^\"]+\", line \d+|Traceback \(most recent call last\)|Caused by: |\.\.\. \d+ more)")
_BULLET = re.compile(r"^(?:[-*+•]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_VOWELS = re.compile(r"[aeiouy]+")
_CODE = re.compile(r"[=;{}<>|\\]|\w\(|\)\s*[{:]|->|\w_\w")


def syllables(word: str) -> int:
    """Vowel groups, a silent final e left out; one at least."""
    w = word.lower()
    n = len(_VOWELS.findall(w))
    if n > 1 and w.endswith("e") and not w.endswith("le"):
        n -= 1
    return max(1, n)


def prose(message: str) -> list[str]:
    """Paragraphs of the author's running prose in a commit message, in any of the layouts.

    The header, the subject, quoted lines, fenced or indented code, traces,
    trailers and everything from a lone `---` on are left out.
    """
    lines = message.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿").split("\n")
    indent = 0
    if _HEADER.match(lines[0]):
        indent = 4 if lines[0].startswith("commit") else 0
        cut = next((k for k, x in enumerate(lines) if not x.strip()), len(lines))
        if lines[0].startswith("From"):
            lines = lines[cut:]  # the subject is one of the headers
        else:
            while cut < len(lines) and not lines[cut].strip():
                cut += 1
            lines = [x[indent:] if x[:indent].isspace() else x for x in lines[cut:]]
            lines = lines[next((k for k, x in enumerate(lines) if not x.strip()), len(lines)) :]
    else:
        lines = lines[next((k for k, x in enumerate(lines) if not x.strip()), len(lines)) :]
    out: list[str] = []
    now: list[str] = []
    fenced = False

    def end() -> None:
        if now:
            out.append(" ".join(now))
            now.clear()

    for raw in lines:
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            end()
        elif fenced:
            pass
        elif line in ("---", "--") or raw.startswith(("diff --", "GIT binary patch")):
            break
        elif not line or line[0] in ">#|" or _TRACE.match(raw) or _TRAILER.match(line) or (raw[:4].isspace() and _CODE.search(line)):
            end()
        else:
            if _BULLET.match(line):
                end()
                line = _BULLET.sub("", line)
            now.append(line)
    end()
    return out


_STATS = pa.schema([("doc_id", pa.int64()), ("words", pa.int32()), ("sentences", pa.int32()), ("syllables", pa.int64()), ("english", pa.int32()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
_STATS_SQL = "doc_id long, words int, sentences int, syllables long, english int, terms array<string>, counts array<int>, sizes array<int>"

#: What the name of a sentence item starts with; no word does.
SENTENCE = "§"


def sentence_class(words: int) -> int:
    """Length class of a sentence, three to a doubling."""
    return int(3 * math.log2(words))


def _measure(least: int):
    """Occurrences of each document's items: its words (size: syllables) and its sentences by length class (size: the class)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text:
                    continue
                counts: dict[str, int] = {}
                lengths: dict[int, int] = {}
                total = 0
                for paragraph in prose(text):
                    for sentence in _END.split(paragraph):
                        got = _WORD.findall(sentence.lower())
                        if got:
                            k = sentence_class(len(got))
                            lengths[k] = lengths.get(k, 0) + 1
                            total += len(got)
                            for w in got:
                                counts[w] = counts.get(w, 0) + 1
                if total < least:
                    continue
                for w in counts:
                    if w not in known:
                        known[w] = syllables(w)
                english = None if lang in (None, "", "und") else int(lang.lower().split("-")[0] == "en")
                rows.append((doc, total, sum(lengths.values()), sum(c * known[w] for w, c in counts.items()), english, list(counts) + [f"{SENTENCE}{k}" for k in lengths], [*counts.values(), *lengths.values()], [known[w] for w in counts] + list(lengths)))
                if len(known) > 500_000:
                    known.clear()
            columns = list(zip(*rows)) if rows else [[]] * len(_STATS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _STATS)], schema=_STATS)

    return run


def _occurrences(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, term, n, size: one row per document and item."""
    return docs.select(*keep, F.explode(F.arrays_zip("terms", "counts", "sizes")).alias("o")).select(*keep, F.col("o.terms").alias("term"), F.col("o.counts").alias("n"), F.col("o.sizes").alias("size"))


def _english(measured: DataFrame) -> DataFrame:
    """The documents in English: those marked so, and of the unmarked ones those whose words are more usual in the marked English ones.

    Word counts are over all marked documents; frequent function words count
    five times beforehand, so that a corpus without marks is told apart too.
    """
    spark = measured.sparkSession
    is_word = ~F.col("term").startswith(SENTENCE)
    seeds = spark.createDataFrame([(w, 5 * (w in ENGLISH), 5 * (w in OTHERS)) for w in sorted(ENGLISH | OTHERS)], "term string, yes long, no long")
    marked = _occurrences(measured.filter("english is not null"), "english").filter(is_word).select("term", (F.col("n") * F.col("english")).cast("long").alias("yes"), (F.col("n") * (1 - F.col("english"))).cast("long").alias("no"))
    usual = store(marked.unionByName(seeds).groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "usual")
    yes, no = usual.agg(F.sum("yes"), F.sum("no")).first()
    weight = usual.select("term", F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5) * F.lit((no + 1.0) / (yes + 1.0))).alias("weight"))
    open_ = measured.filter("english is null").withColumn("row", F.monotonically_increasing_id())
    open_ = store(open_, "unmarked")
    score = _occurrences(open_, "row").filter(is_word).join(weight, "term").groupBy("row").agg(F.sum(F.col("n") * F.col("weight")).alias("score")).filter("score > 0").select("row")
    return measured.filter("english = 1").unionByName(open_.join(score, "row", "left_semi").drop("row"))


GRID = np.linspace(-6.0, 6.0, 241)
_STEP = GRID[1] - GRID[0]


#: Standard deviation of a threshold around its link to the published scale, and where the ratings run against that scale.
LINK_SD = (0.1, 2.0)


@dataclass
class Facets:
    """What the driver holds of the ratings' side: a few numbers, whatever the corpus."""

    thresholds: np.ndarray
    slope: float = 3.0
    severity: dict[str, float] = field(default_factory=dict)


def equate(counts: np.ndarray, shares: list[float]) -> np.ndarray:
    """Equipercentile linking: the levels below which the given shares of the documents lie. `counts`: documents by level on GRID."""
    below = np.concatenate([[0.0], np.cumsum(counts)]) / counts.sum()
    edges = np.concatenate([[GRID[0] - _STEP / 2], GRID + _STEP / 2])
    inside = np.flatnonzero(np.diff(below) > 0)
    keep = np.unique(np.concatenate([inside, inside + 1]))
    return np.maximum.accumulate(np.interp(shares, below[keep], edges[keep]) + 1e-6 * np.arange(len(shares)))


def gap_prior(counts: np.ndarray, width: float = 0.1, weight: float = 2.0) -> np.ndarray:
    """Log prior of a threshold on GRID: reading levels are apart, so few documents lie at a bound. `counts`: documents by level."""
    kernel = np.exp(-0.5 * (np.arange(-20, 21) * _STEP / width) ** 2)
    smooth = np.convolve(counts, kernel / kernel.sum(), "same") / max(1.0, counts.sum()) / _STEP
    return -weight * np.log(smooth + 0.02)


def fit_facets(rows: list[tuple[float, str, int]], facets: Facets, prior: np.ndarray, gaps: np.ndarray, prior_sd: float, steps: int = 60) -> Facets:
    """Thresholds, slope and severities given the documents' levels: Newton steps of the penalised ordinal likelihood, then each threshold's best place on GRID."""
    if not rows:
        return Facets(prior)
    theta = np.array([r[0] for r in rows])
    names = sorted({r[1] or "" for r in rows})
    place = {x: k for k, x in enumerate(names)}
    who = np.array([place[r[1] or ""] for r in rows])
    above = np.array([r[2] for r in rows])[:, None] > np.arange(1, len(BOUNDS) + 1)[None, :]
    tau, rho, slope = facets.thresholds.copy(), np.array([facets.severity.get(x, 0.0) for x in names]), facets.slope
    for _ in range(steps):
        x = theta[:, None] - tau[None, :] - rho[who][:, None]
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        e, v = above - p, p * (1 - p)
        tau = tau - np.clip((slope * e.sum(0) + (tau - prior) / prior_sd**2) / (slope**2 * v.sum(0) + prior_sd**-2), -0.2, 0.2)
        g = np.bincount(who, slope * e.sum(1), len(names)) + rho / 0.1**2
        rho = rho - np.clip(g / (np.bincount(who, slope**2 * v.sum(1), len(names)) + 0.1**-2), -0.1, 0.1)
        slope = float(np.clip(slope + np.clip((e * x).sum() / ((v * x * x).sum() + 0.1), -0.5, 0.5), 0.5, 25))
    x = np.clip(slope * (theta[:, None] - rho[who][:, None] - GRID[None, :]), -30, 30)
    yes, no = -np.log1p(np.exp(-x)), -np.log1p(np.exp(x))
    fit = np.stack([np.where(above[:, k : k + 1], yes, no).sum(0) - (GRID - prior[k]) ** 2 / (2 * prior_sd**2) for k in range(len(BOUNDS))])
    tau = np.sort(GRID[(fit + gaps[None, :]).argmax(1)])
    return Facets(tau, slope, dict(zip(names, rho.tolist())))


def solve_levels(score: np.ndarray, words: np.ndarray, sentences: np.ndarray, spread: np.ndarray, pull=None) -> np.ndarray:
    """The levels at which the likelihood of the documents' occurrences is greatest.

    `score` is the sum of difficulties over a document's occurrences and
    `spread` the log normalisers of words and sentences on GRID. The slope of
    the log likelihood falls in the level, so bisection finds its zero.
    """
    mean = np.gradient(spread, _STEP, axis=1)
    low, high = np.full(len(score), GRID[0]), np.full(len(score), GRID[-1])
    for _ in range(22):
        at = (low + high) / 2
        slope = score - words * np.interp(at, GRID, mean[0]) - sentences * np.interp(at, GRID, mean[1]) - at
        if pull is not None:
            slope = slope + pull(at)
        low, high = np.where(slope > 0, at, low), np.where(slope > 0, high, at)
    return (low + high) / 2


def solve_difficulties(n: np.ndarray, moment: np.ndarray, exposure: np.ndarray, prior: np.ndarray, sd: float) -> tuple[np.ndarray, np.ndarray]:
    """(ease, difficulty) of items that occur n times, with `moment` the sum of levels over these, at log exposures on GRID (item x grid).

    For each item the log likelihood is concave once its ease is profiled out,
    so bisection finds the difficulty at which observed and expected moments agree.
    """
    low, high = np.full(len(n), -12.0), np.full(len(n), 12.0)
    for _ in range(28):
        b = (low + high) / 2
        e = b[:, None] * GRID + exposure
        p = np.exp(e - e.max(1, keepdims=True))
        slope = moment - n * (p @ GRID) / p.sum(1) - (b - prior) / sd**2
        low, high = np.where(slope > 0, b, low), np.where(slope > 0, high, b)
    b = (low + high) / 2
    e = b[:, None] * GRID + exposure
    top = e.max(1)
    return np.log(n) - top - np.log(np.exp(e - top[:, None]).sum(1)), b


_ITEMS = pa.schema([("term", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("ease", pa.float64()), ("difficulty", pa.float64()), ("prior", pa.float64())])


def _item_step(exposure: np.ndarray, prior: list[tuple[float, float]], sd: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4_096):
                part = batch.slice(a, 4_096)
                term, n, size, moment = (part.column(k) for k in range(4))
                block = np.array([t.startswith(SENTENCE) for t in term.to_pylist()], int)
                x = size.to_numpy().astype(float)
                mean = np.array(prior)[block, 0] + np.array(prior)[block, 1] * x
                ease, b = solve_difficulties(n.to_numpy().astype(float), moment.to_numpy(), exposure[block], mean, sd)
                yield pa.RecordBatch.from_arrays([term, n, size, pa.array(ease), pa.array(b), pa.array(mean)], schema=_ITEMS)

    return run


def _normaliser_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: at each grid point the summed weight of the words and of the sentence classes."""
    total = np.zeros((2, len(GRID)))
    for batch in batches:
        for a in range(0, batch.num_rows, 4_096):
            term, ease, b = (batch.slice(a, 4_096).column(k) for k in range(3))
            block = np.array([t.startswith(SENTENCE) for t in term.to_pylist()], bool)
            weight = np.exp(np.clip(ease.to_numpy()[:, None] + b.to_numpy()[:, None] * GRID, -700, 300))
            total[0] += weight[~block].sum(0)
            total[1] += weight[block].sum(0)
    at = [(k, i) for k in (0, 1) for i in range(len(GRID))]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array(total.ravel())], names=["block", "at", "weight"])


def _level_step(spread: np.ndarray, facets: Facets):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, words, sentences, score, ratings = (batch.column(k) for k in range(5))
            t, w, s = (c.to_numpy().astype(float) for c in (score, words, sentences))
            plain = solve_levels(t, w, s, spread)
            level = plain.copy()
            said = [(k, x["reader"] or "", x["rating"]) for k, xs in enumerate(ratings.to_pylist()) if xs for x in xs]
            if said:
                rated = np.array(sorted({k for k, _, _ in said}))
                row = np.searchsorted(rated, [k for k, _, _ in said])
                shift = np.array([facets.severity.get(x, 0.0) for _, x, _ in said])[:, None] + facets.thresholds[None, :]
                above = np.array([r for _, _, r in said])[:, None] > np.arange(1, len(BOUNDS) + 1)[None, :]

                def pull(at: np.ndarray) -> np.ndarray:
                    p = 1 / (1 + np.exp(-np.clip(facets.slope * (at[row][:, None] - shift), -30, 30)))
                    return np.bincount(row, facets.slope * (above - p).sum(1), len(rated))

                level[rated] = solve_levels(t[rated], w[rated], s[rated], spread, pull)
            fit = t * level - w * np.interp(level, GRID, spread[0]) - s * np.interp(level, GRID, spread[1]) - level**2 / 2
            yield pa.RecordBatch.from_arrays([doc, words, sentences, pa.array(level), pa.array(plain), pa.array(fit)], names=["doc_id", "words", "sentences", "theta", "plain", "fit"])

    return run


def _start(measured: DataFrame, ratings: DataFrame, calibration_rows: int) -> tuple[Column, bool]:
    """Levels to start from: mean word size and log sentence length, weighed alike, turned round if ratings fall with them; and whether they do."""
    size, length = F.col("syllables") / F.col("words"), F.log(F.col("words") / F.col("sentences"))
    m1, s1, m2, s2 = (x or 0.0 for x in measured.agg(F.mean(size), F.stddev(size), F.mean(length), F.stddev(length)).first())
    a, b = (size - m1) / (s1 or 1.0), (length - m2) / (s2 or 1.0)
    at = (a + b) / math.sqrt(2)
    turn = _sample(measured.select("doc_id", at.alias("at")).join(ratings, "doc_id"), calibration_rows).agg(F.covar_pop("at", "rating")).first()[0]
    turned = (turn or 0.0) < 0
    return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), -at if turned else at)), turned


def _sample(rated: DataFrame, rows: int) -> DataFrame:
    return rated.orderBy(F.xxhash64("doc_id", "reader"), "rating").limit(rows)


def reading_levels(docs: DataFrame, labels: DataFrame, least_words: int = 40, iterations: int = 12, tolerance: float = 5e-4, difficulty_sd: float = 0.25, calibration_rows: int = 20_000) -> DataFrame:
    """doc_id, reading_level (1-4), level (years of schooling) and words of each document with enough English prose.

    The model: an occurrence in a document of level t is item i with
    probability exp(ease_i + difficulty_i t) / Z(t), for its words and for its
    sentences' length classes; t is normal around 0. A rating exceeds k with
    logit slope (t - threshold_k - severity of the reader). Levels of all
    documents and difficulties of all items are estimated in turn, each step
    raising the penalised likelihood; it ends when an alternation gains less
    than `tolerance` an occurrence, or after `iterations`. The prior mean of a
    difficulty is a line in the word's syllables or the sentence's class, fitted
    in each alternation.

    Thresholds, slope and severities are fitted on at most `calibration_rows`
    ratings, taken by the hash of doc_id and reader, and turn levels into
    reading levels and years. Their prior, which alone stands without ratings,
    links levels to the published scale by equal percentiles.

    Null or empty texts, other languages and shorter prose give no row. `lang`
    tells the language; where it is null or `und`, or is lacking as a column,
    the words tell. Rows that repeat a doc_id count once (the one with more
    words, then more sentences). Null ratings or ratings outside 1-4 are
    ignored, other columns too.
    """
    message = F.substring_index(F.substring_index(F.regexp_replace("text", "\r\n?", "\n"), "\ndiff --git ", 1), "\nGIT binary patch", 1)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), message.alias("message"), lang.cast("string").alias("lang")).filter("doc_id is not null and message is not null")
    every = store(source.mapInArrow(_measure(least_words), _STATS_SQL), "prose")
    rest = [c for c in _STATS.names if c not in ("doc_id", "words", "sentences")]
    once = _english(every).groupBy("doc_id").agg(F.max(F.struct("words", "sentences", *rest)).alias("r")).select("doc_id", "r.*")
    measured = store_bucketed(once, "doc_id", "prose")
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reader").cast("string").alias("reader"), F.col("reading_level").cast("int").alias("rating")).filter("rating between 1 and 4").dropDuplicates()
    said = store(ratings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("reader", "rating"))).alias("ratings")), "ratings")
    published = F.lit(ORIGIN) + PER_SENTENCE_WORD * F.col("words") / F.col("sentences") + PER_SYLLABLE * F.col("syllables") / F.col("words")
    total, *shares = measured.agg(F.sum(F.col("words") + F.col("sentences")), *[F.mean((published <= x).cast("double")) for x in BOUNDS]).first()
    if not total:
        return measured.select("doc_id", F.lit(1).alias("reading_level"), F.lit(0.0).alias("level"), "words")
    start, turned = _start(measured, ratings, calibration_rows)
    levels = store(measured.select("doc_id", "words", "sentences", start.alias("theta")), "levels")
    spread = np.zeros((2, len(GRID)))
    prior = [(0.0, 0.0), (0.0, 0.0)]
    facets: Facets | None = None
    before = -math.inf
    for _ in range(iterations):
        point = F.round((F.col("theta") - float(GRID[0])) / float(_STEP)).cast("int")
        exposure = np.full((2, len(GRID)), -np.inf)
        for at, w, s in levels.groupBy(point.alias("at")).agg(F.sum("words"), F.sum("sentences")).collect():
            exposure[:, at] = np.log([w, s])
        exposure -= spread
        moments = _occurrences(measured.join(levels.select("doc_id", "theta"), "doc_id"), "theta").groupBy("term").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sum(F.col("n") * F.col("theta")).alias("moment"))
        items = store(moments.mapInArrow(_item_step(np.maximum(exposure, -1e6), prior, difficulty_sd), "term string, n long, size int, ease double, difficulty double, prior double"), "items")
        spread = np.zeros((2, len(GRID)))
        for block, at, weight in items.select("term", "ease", "difficulty").mapInArrow(_normaliser_parts, "block int, at int, weight double").groupBy("block", "at").agg(F.sum("weight")).collect():
            spread[block, at] = math.log(weight) if weight > 0 else -700.0
        sure = F.col("n") / (F.col("n") + 20.0)
        fitted = items.groupBy(F.col("term").startswith(SENTENCE).cast("int").alias("block")).agg(F.sum(sure), F.sum(sure * F.col("size")), F.sum(sure * F.col("difficulty")), F.sum(sure * F.col("size") * F.col("size")), F.sum(sure * F.col("size") * F.col("difficulty")), F.sum(F.col("n") * F.col("ease") - (F.col("difficulty") - F.col("prior")) ** 2 / (2 * difficulty_sd**2))).collect()
        for block, k, x, y, xx, xy, _ in fitted:
            slope = (xy - x * y / k) / (xx - x * x / k + 1.0)
            prior[block] = (float(y / k - slope * x / k), float(slope))
        scores = _occurrences(measured, "doc_id", "words", "sentences").join(items.select("term", "difficulty"), "term").groupBy("doc_id").agg(F.first("words").alias("words"), F.first("sentences").alias("sentences"), F.sum(F.col("n") * F.col("difficulty")).alias("score"))
        step = scores.join(said, "doc_id", "left").select("doc_id", "words", "sentences", "score", "ratings")
        levels = store(step.mapInArrow(_level_step(spread, facets or Facets(np.zeros(len(BOUNDS)), 0.0)), "doc_id long, words int, sentences int, theta double, plain double, fit double"), "levels")
        fit = 0.0
        counts = np.zeros(len(GRID))
        for at, n, part in levels.groupBy(F.round((F.col("plain") - float(GRID[0])) / float(_STEP)).cast("int")).agg(F.count("*"), F.sum("fit")).collect():
            counts[at] = n
            fit += part
        equated = equate(counts, shares)
        sample = _sample(levels.join(ratings, "doc_id"), calibration_rows).select("plain", "reader", "rating").collect()
        facets = fit_facets([tuple(r) for r in sample], facets or Facets(equated), equated, gap_prior(counts), LINK_SD[turned])
        now = (fit + sum(r[-1] for r in fitted)) / total
        if now - before < tolerance:
            break
        before = now
    at = F.col("plain")
    level = F.lit(1)
    for t in facets.thresholds:
        level = level + F.when(at > float(t), 1).otherwise(0)
    return levels.select("doc_id", level.cast("int").alias("reading_level"), _years(at, facets.thresholds).alias("level"), "words")


def _years(theta: Column, thresholds: np.ndarray) -> Column:
    """Years of schooling: straight lines through the thresholds, which stand at BOUNDS."""
    slopes = [(BOUNDS[k + 1] - BOUNDS[k]) / max(1e-6, thresholds[k + 1] - thresholds[k]) for k in range(len(BOUNDS) - 1)]
    out = None
    for k, slope in enumerate(slopes):
        line = F.lit(BOUNDS[k]) + (theta - float(thresholds[k])) * float(slope)
        out = line if out is None else F.when(theta > float(thresholds[k]), line).otherwise(out)
    return out
