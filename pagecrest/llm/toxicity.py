"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer maps each word to a symbol: insult, harm verb, intent, second or third person,
negation, reporting word or other; quotation marks, commas, colons, sentence ends and line ends have
symbols too. Grammar transducers then rewrite the insults: one marks those in the scope of a negation,
which goes to the next comma, colon, contrast or sentence end; one those in reported speech, which goes
from a reporting word over a colon to the sentence's end or lasts as long as a quotation; one those
aimed at somebody named before in the sentence, or addressed after; one makes a threat of intent, harm
and person, close together. They are composed into a single machine; every sentence that yields an
insult or a threat adds its weight to the evidence for its path. Evidence, not lone words, goes into a
logistic score whose weights are learned.

Insults are learned from labelled texts: whole words and word beginnings that are far commoner in
toxic texts, each with its log odds as weight, chosen one by one to explain the toxic texts. The grammar's function words are fixed lists.
Learning takes a sample by hash of about `max_labelled` labelled ids; what it counts per word is
gathered by Spark, and the driver gets the matches of the lexicon only.

Defined results: null and empty texts score as texts without evidence; null labels teach nothing;
with no labels every score is the same, below 0.5; an id with both labels is toxic; repeated
rows and ids return each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import settle

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„‟]|[.!?;:,\n…]")
WORD = re.compile(r"[^\W\d_]+")
#: Function words of the grammar, in English, German, French and Spanish.
ADDRESSED = "you your yours yourself yourselves you're you'll du dich dir dein deine deinen deiner euch ihr euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
PERSONS = "he him his she her they them their theirs we us everyone everybody people er ihn ihm sie ihnen alle jeder il elle lui ils elles eux leur tous él ella ellos ellas todos"
NEGATIONS = "not no never none nor neither cannot can't don't doesn't didn't isn't aren't wasn't weren't won't wouldn't nicht kein keine keinen keiner nie niemals ne n'es n'est n'êtes pas jamais aucun aucune ni nunca jamás ningún ninguna"
REPORTS = "said says say saying told tells called calls calling wrote writes claimed claims quoted quote quotes reported reports shouted sagte sagt sagen nannte nennt schrieb schreibt rief zitierte dit disait dire appelé appelle écrit écrivait cite crié dijo dice decir llamó llama escribió escribe gritó"
INTENTS = "will gonna going shall must should would want wanna i'll we'll i'd werde werden wird will wollen müssen soll vais va allons vont veux voulons dois voy vamos van quiero queremos debo"
CONTRASTS = "but yet aber sondern doch mais pero sino"
#: Harm verbs: beginnings, and what may follow them.
HARMS = {
    "kill": " s ed ing er", "hurt": " s ing", "destroy": " s ed ing", "beat": " s en ing", "shoot": " s ing", "shot": "", "stab": " s bed bing", "murder": " s ed ing", "burn": " s ed ing t", "hang": " s ed ing", "strangl": "e es ed ing",
    "töte": " n t st te ten", "getötet": "", "schlag": "e en", "schläg": "t st", "geschlagen": "", "umbring": "e en t", "umgebracht": "", "verletz": "e en t", "erschieß": "e en t", "verbrenn": "e en t",
    "tue": " r s z rai ra rons", "tué": " e s", "frappe": " r s z rai ra", "détrui": "re s t rai", "brûle": " r rai", "mata": " r ré rá remos", "mato": "", "matemos": "", "golpea": " r ré rá", "destrui": "r ré rá", "quema": " r ré rá",
}
CLASSES = {w: s for s, words in (("T", PERSONS), ("Y", ADDRESSED), ("N", NEGATIONS), ("R", REPORTS), ("M", INTENTS), ("C", CONTRASTS)) for w in words.split()}
CLASSES |= {stem + end.strip(): "H" for stem, ends in HARMS.items() for end in (ends.split(" ") if ends else [""])}
CLASSES |= dict.fromkeys('"“”«»„‟', "Q") | dict.fromkeys(".!?;…", "S") | {",": "C", ":": "K", "\n": "P"}
#: I insult, T and Y third and second person, N negation, R report, M intent, H harm, Q quotation mark, C comma
#: or contrast, K colon, S end of a sentence, P end of a line, O other.
SYMBOLS = "ITYNRMHQCKSPO"
#: Other words that may stand between intent and harm, and between harm and person.
NEAR, NEXT = 3, 2
PATHS = ("plain", "negated", "reported", "targeted", "threat")
#: Lengths of word beginnings that may be learned.
STEMS = range(4, 9)
#: Evidence: of each path the logarithm of its clauses' weights, and how dense they are.
N_EVIDENCE = len(PATHS) + 1
OUTPUTS = {"I": "plain", "i": "negated", "r": "reported", "j": "targeted", "X": "threat"}
#: Weight of a threat.
THREAT = 4.0


@dataclass
class Transducer:
    """Finite-state transducer: (state, symbol) -> (output, next state). A symbol without an arc
    goes out unchanged, by the state's arc for any other symbol if it has one."""

    arcs: dict[tuple[int, str], tuple[str, int]] = field(default_factory=dict)
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        if (hit := self.arcs.get((state, symbol))) is not None:
            return hit
        return symbol, self.other.get(state, state)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """One machine that does what second does to first's output; states are numbered as reached."""
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        a, b = here = todo.pop()
        for s in symbols:
            middle, a2 = first.step(a, s)
            end, b2 = second.step(b, middle)
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            out.arcs[number[here], s] = (end, number[a2, b2])
    return out


def grammar_parts() -> list[Transducer]:
    """The transducers in the order in which they apply. Symbols out: I plain, i negated, r reported,
    j targeted insult, U what makes the sentence's plain insults targeted, X threat, the rest as
    they are."""
    # From a negation to the end of its clause.
    negation = Transducer({(0, "N"): ("N", 1), (1, "I"): ("i", 1), (1, "H"): ("O", 1)} | {(1, s): (s, 0) for s in "CKSP"})
    # After a reporting word, and within a quotation, whose end is the speech's end.
    report = Transducer({(0, "R"): ("R", 1), (1, "S"): ("S", 0), (1, "P"): ("P", 0), (2, "P"): ("P", 0), (2, "Q"): ("Q", 0)})
    for k in (0, 1):
        report.arcs[k, "Q"] = ("Q", 2)
    for k in (1, 2):
        report.arcs |= {(k, "I"): ("r", k), (k, "i"): ("r", k), (k, "H"): ("O", k)}
    # With a person before, or an insult that waits for one to be addressed.
    target = Transducer({(0, "T"): ("T", 1), (0, "Y"): ("Y", 1), (1, "I"): ("j", 1), (0, "I"): ("I", 2), (2, "Y"): ("U", 1)})
    target.arcs |= {(k, s): (s, 0) for k in (1, 2) for s in "SP"}
    # Intent, harm and person, or intent, person and harm, with few other words between.
    threat = Transducer()
    after = 1 + NEAR + 1  # the state behind a harm verb
    named = after + NEXT  # with a person since the intent, state k is named + k
    for k in range(named + after):
        threat.arcs |= {(k, s): (s, 0) for s in "CKSP"} | {(k, "M"): ("M", 1)}
    for k in range(1, after):
        threat.arcs[k, "H"] = ("H", after)
        threat.arcs[named + k, "H"] = ("X", 0)
        if k + 1 < after:
            threat.arcs |= {(k, s): (s, named + k + 1) for s in "TYU"}
            threat.other |= {k: k + 1, named + k: named + k + 1}
        else:
            threat.other |= {k: 0, named + k: 0}
    for k in range(after, after + NEXT + 1):
        threat.arcs |= {(k, s): ("X", 0) for s in "TYU"}
        threat.other[k] = k + 1 if k < after + NEXT else 0
    return [negation, report, target, threat]


def grammar() -> Transducer:
    out, *rest = grammar_parts()
    for part in rest:
        out = compose(out, part, SYMBOLS)
    return out


class Lexicon:
    """Insult words and beginnings of words with weights, found by one automaton over the text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.machine = grammar()
        finder = ahocorasick.Automaton()
        for w in {*words, *stems, *HARMS}:
            finder.add_word(w, w)
        finder.make_automaton()
        self.finder = finder if len(finder) else None

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for k in STEMS:
            w = max(w, self.stems.get(word[:k], 0.0))
        return w

    def symbol(self, token: str) -> tuple[str, float]:
        """What the lexicon makes of a token, and an insult's weight."""
        w = self.weight(token)
        return ("I", w) if w else (CLASSES.get(token, "O"), 0.0)

    def evidence(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, str, float]]]:
        """Evidence for each path, and the matched sentences: start, end, path, weight."""
        total, spans, hits = np.zeros(N_EVIDENCE), [], 0
        low = text.lower()
        if next(self.finder.iter(low), None) is None:
            return total, spans
        step, state, start, end = self.machine.arcs, 0, 0, 0
        found: Counter[str] = Counter()
        for m in TOKEN.finditer(low):
            symbol, w = self.symbol(m[0])
            out, state = step[state, symbol]
            if symbol in "SP":
                spans += [(start, end, path, w) for path, w in found.items()]
                found.clear()
                start = m.end()
                continue
            end = m.end()
            if out == "U":  # the insults before were aimed at whom this addresses
                found["targeted"] += found.pop("plain", 0.0)
            elif path := OUTPUTS.get(out):
                found[path] += w if symbol == "I" else THREAT
                hits += 1
        spans += [(start, end, path, w) for path, w in found.items()]
        for _, _, path, w in spans:
            total[PATHS.index(path)] += w
        total[-1] = 100 * hits / max(1, len(low.split()))
        return np.log1p(total), spans


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    weights: np.ndarray

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights + self.bias, -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with and without toxicity that have each word or beginning of a longer word."""
    counts: dict[tuple[str, bool], list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(counts)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [counts[k][1] for k in keys], [counts[k][0] for k in keys]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["term", "stem", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(WORD.findall((text or "").lower()))
            for key in {*((w, False) for w in words), *((w[:k], True) for w in words for k in STEMS if len(w) > k)}:
                counts.setdefault(key, [0, 0])[toxic] += 1
            if len(counts) > 400_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def chosen(candidates: list[tuple[str, bool, float, float]], texts: list[tuple[list[int], bool, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that together explain the toxic texts, best first.

    candidates: term, whether it is a beginning, weight, share of toxic texts among those with it.
    texts: candidates present, toxic, number of such texts. A term joins for what it says about texts
    that no chosen term is in yet; a clear one also for texts that only one is in.
    """
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    has = np.zeros((len(texts), len(candidates)), bool)
    for row, (found, _, _) in zip(has, texts):
        row[found] = True
    many = np.array([n for _, _, n in texts], float)
    bad = many * np.array([t for _, t, _ in texts])
    good = many - bad
    clear = np.array([c[3] >= 0.8 for c in candidates])
    covered = np.zeros(len(texts), int)
    share = (bad @ has) / max(1.0, bad.sum())
    for k in np.flatnonzero((share >= 0.1) & (np.array([c[3] for c in candidates]) >= 0.9)):  # plain to see
        if not any(c[0] != candidates[k][0] and c[0].startswith(candidates[k][0]) and share[j] >= 0.9 * share[k] for j, c in enumerate(candidates)):
            (stems if candidates[k][1] else words)[candidates[k][0]] = candidates[k][2]
            covered += has[:, k]
    for depth in (1, 2):
        open_terms = np.ones(len(candidates), bool) if depth == 1 else clear.copy()
        while True:
            left = covered < depth
            n1, n0 = bad[left].sum(), good[left].sum()
            c1, c0 = bad[left] @ has[left], good[left] @ has[left]
            ratio = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 2) / (n0 + 4))
            gain = np.where(open_terms & (c1 >= 3) & (ratio >= 4), c1 * np.log(np.maximum(ratio, 1e-9)), 0.0)
            gain[[c[0] in (stems if c[1] else words) for c in candidates]] = 0
            # Of equals the longer form is the clearer.
            best = max(range(len(candidates)), key=lambda k: (round(gain[k], 6), len(candidates[k][0]), candidates[k][0]), default=None)
            if best is None or gain[best] < 12:
                break
            term, stem, weight, _ = candidates[best]
            (stems if stem else words)[term] = weight
            covered += has[:, best]
    return words, stems


def folded(found: list) -> list:
    """Candidates, of which those that begin another one and are as often in toxic and in clean texts
    are left out: the longer form says the same more clearly."""
    longer: dict[tuple[int, int], list[str]] = {}
    for r in found:
        longer.setdefault((r["toxic"], r["clean"]), []).append(r["term"])
    alike = lambda r: (t for t in longer[r["toxic"], r["clean"]] if t.startswith(r["term"]))
    return [r for r in found if not any(len(t) > len(r["term"]) for t in alike(r))]


def fit(labelled: DataFrame, text: str, toxic: str, least_share: float = 0.02, least_ratio: float = 4.0, max_terms: int = 500) -> Model:
    """Model from a bounded table of labelled texts; toxic is 1 or 0. max_terms bounds the candidates of
    the lexicon, where a word and its beginnings that are in the same texts are one."""
    rows = settle(labelled.where(F.col(toxic).isNotNull()).select(F.col(text).alias("text"), (F.col(toxic) == 1).alias("toxic")))
    n1, n = (rows.where("toxic").count(), rows.count())
    n0 = n - n1
    if not n1 or not n0:
        return Model(Lexicon({}, {}), -3.0, np.zeros(N_EVIDENCE))
    least = max(3, math.ceil(least_share * n1))
    parts = rows.select("text", "toxic").repartition(8)
    terms = parts.mapInArrow(_terms, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 2.0) / (n0 + 4))
    found = terms.where(F.col("toxic") >= least).withColumn("w", odds).where(F.col("w") >= math.log(least_ratio))
    found = found.orderBy(F.desc(F.col("toxic") * F.col("w")), F.desc(F.length("term")), "term", "stem").limit((len(STEMS) + 1) * max_terms).collect()
    candidates = [(r["term"], r["stem"], r["w"], r["toxic"] / (r["toxic"] + r["clean"])) for r in folded(found)[:max_terms]]
    number = {c[:2]: k for k, c in enumerate(candidates)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                seen = set(WORD.findall((text or "").lower()))
                keys = {*((w, False) for w in seen), *((w[:k], True) for w in seen for k in STEMS if len(w) > k)}
                out.append(sorted(number[k] for k in keys if k in number))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column(1)], ["terms", "toxic"])

    texts = [tuple(r) for r in parts.mapInArrow(present, "terms array<int>, toxic boolean").groupBy("terms", "toxic").count().collect()]
    lexicon = Lexicon(*chosen(candidates, texts))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.evidence(t or "")[0].tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = parts.mapInArrow(matched, "x array<double>, toxic boolean").groupBy("x", "toxic").count().collect()
    x = np.array([r["x"] for r in got])
    y, many = np.array([r["toxic"] for r in got], float), np.array([r["count"] for r in got], float)
    # Logistic regression by Newton's method, drawn towards a prior: a path's evidence speaks for
    # toxicity, less so if negated or reported.
    prior = np.array([1.0, 0.3, 0.3, 1.2, 1.0, 0.5, -2.0])
    design = np.c_[x, np.ones(len(x))]
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (many * (y - p)) - 2 * (beta - prior)
        hessian = (design * (many * p * (1 - p))[:, None]).T @ design + 2 * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta += move
        if np.abs(move).max() < 1e-10:
            break
    beta[:-1] = np.maximum(beta[:-1], 0)
    for path in ("negated", "reported"):  # rare, so what few texts say is bounded by the plain path
        k = PATHS.index(path)
        beta[k] = min(beta[k], beta[PATHS.index("plain")])
    return Model(lexicon, float(beta[-1]), beta[:-1])


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that each text is toxic. The model is a few hundred terms."""
    held = docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.bias, model.weights))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, stems, bias, weights = held.value
        m = Model(Lexicon(words, stems), bias, weights)
        for part in texts:
            yield pd.Series(m.score(np.array([m.lexicon.evidence(t or "")[0] for t in part]).reshape(-1, N_EVIDENCE)))

    return docs.withColumn(out, score(F.col(text)))


def with_clauses(docs: DataFrame, model: Model, text: str = "text", out: str = "clauses") -> DataFrame:
    """docs with the matched clauses of each text: start and end in characters, path and weight."""
    words, stems = model.lexicon.words, model.lexicon.stems

    @F.pandas_udf("array<struct<start:int,end:int,path:string,weight:double>>")
    def clauses(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(words, stems)
        for part in texts:
            yield part.map(lambda t: [dict(zip(("start", "end", "path", "weight"), s)) for s in lexicon.evidence(t or "")[1]])

    return docs.withColumn(out, clauses(F.col(text)))


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", max_labelled: int = 12_000, **options) -> Model:
    """Model from the labelled rows of docs for which train holds, of about max_labelled labelled ids
    at most: those whose hash falls into that share."""
    by_id = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(toxic).alias("_toxic"))
    share = min(1.0, max_labelled / max(1, by_id.count()))
    sample = by_id.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(1 << 30)) < round(share * (1 << 30)))
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    # The sampled labels are bounded, so texts need not be shuffled to meet them.
    return fit(rows.join(F.broadcast(sample), F.col("_doc") == F.col("_id")), "_text", "_toxic", **options)
