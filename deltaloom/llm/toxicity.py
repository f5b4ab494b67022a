"""Toxicity by a weighted grammar of composed finite-state transducers.

The lexicon turns words into symbols: insult, threat, slur, person, second person, its object form,
negation, report, other. Three small transducers rewrite a clause's symbols one after the other,
each reading what the one before wrote; they are composed into one machine, whose table is built once:

* report: after a verb of saying the rest of the clause is someone else's speech, and insults and
  threats in it become `reported`;
* negation: reaches over the next few words, whose insults and threats become `negated`;
* target: once a person is addressed or spoken of, insults become `insult_target`; where that comes
  later in the clause, its final state says so. A threat with the second person in the few words
  after it, or with its object form in the few before, becomes `threat_target`.

Insults and threats use up no reach, so one more of them never takes another out of its context.

A clause keeps all of its readings, and each implies the weaker ones (IMPLIED): its weight is the
sum of theirs. Documents are scored by how many clauses have each reading, in a logistic model whose
weights are not negative, so that a further insult or threat never lowers a score. A threat at a
person weighs at least what an insult at one does, as labels may show insults only.

Words that open with a learned stem are slurs, or threats if they stand as threats do. A slur is an
insult whatever stands before it: its label counts were taken over all contexts, and it may be of a
language whose negations are not known here. Stems and weights are learned from a bounded,
deterministic sample of labelled rows. Texts are searched whole: an automaton finds insult and
threat words, and only clauses that hold one are parsed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deltaloom.llm.common import bounded_batches, crc_mod, cut, pieces

#: Labelled rows that stems and weights are learned from, at most, and stems that are kept, at most.
SAMPLE_ROWS = 20_000
MAX_STEMS = 5_000
#: Letters of the shortest and the longest stem.
STEM = (4, 8)
#: Times the gain that chance could reach, from which a stem needs no documents of its own.
SURE = 4
#: Share of a stem's toxic documents in which it stands as a threat does, from which it is one.
THREATENING = 0.8
FOLDS = 5

INSULTS = "asshole bastard bitch clown creep cretin disgusting dumb dumbass filth freak fool garbage idiot imbecile idiotic jerk loser moron pathetic pig scum stupid trash vermin worthless arschloch dummkopf abschaum trottel dreckskerl connard salaud ordure crétin imbécile estúpido imbécil basura cabrón gilipollas".split()
THREATS = "kill hurt destroy stab shoot strangle murder hang beat burn töten umbringen vernichten tuer tuerai détruire matar mataré destruir".split()
#: Persons; those that are addressed, and their object forms, are told apart from the others.
OBJECTS = frozenset("dich dir euch te toi".split())
SECONDS = frozenset("you your yours u ur yourself du dein deine ihr ton ta vous votre tu tú ti usted ustedes vosotros".split())
TARGETS = frozenset("he she they him her them these those people sie ils elles ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody nothing neither nor isn aren wasn don doesn didn won wouldn cannot without nicht kein keine niemand nie ohne ne pas jamais personne sans nunca jamás nadie sin".split())
REPORTS = frozenset("said says say saying called calls quoted quote wrote writes reported reportedly claimed sagte sagt schrieb dit disait écrit dijo dice escribió".split())
#: Words that a negation reaches.
REACH = 3
READINGS = ("threat_target", "insult_target", "insult", "threat", "negated", "reported")
#: The weaker readings that each implies.
IMPLIED = {"threat_target": READINGS, "insult_target": ("insult", "negated", "reported"), "insult": ("negated", "reported"), "threat": ("negated", "reported")}
#: Where the weights start, and are drawn to where labels say little: bias, then what each of READINGS adds to those it implies.
PRIOR = np.array([-3.0, 0.0, 1.0, 2.5, 0.5, 0.25, 0.25])
RIDGE = 0.05

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n\r]")


@dataclass
class Grammar:
    """Insult words and stems, threat words, and the weights of the readings."""

    words: dict[str, str]
    stems: dict[str, str]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def automaton(self) -> ahocorasick.Automaton:
        """Spellings with their length, what they are as a whole word, and as the start of a longer one."""
        found = ahocorasick.Automaton()
        for w in self.words.keys() | self.stems.keys():
            found.add_word(w, (len(w), self.words.get(w), self.stems.get(w)))
        found.make_automaton()
        return found


def default_grammar(stems: dict[str, str] | None = None) -> Grammar:
    return Grammar({w: "insult" for w in INSULTS} | {w: "threat" for w in THREATS}, stems or {})


SYMBOLS = ("insult", "threat", "slur", "target", "second", "object", "negation", "report", "other")
HITS = ("insult", "threat")
#: A transducer's step: (state, symbol) to the next state and the symbol written. All start in state 0.
Step = Callable[[int, str], tuple[int, str]]


def report(state: int, symbol: str) -> tuple[int, str]:
    """State 1 once a verb of saying was read."""
    return int(state or symbol == "report"), "reported" if state and symbol in HITS else symbol


def negation(state: int, symbol: str) -> tuple[int, str]:
    """The state is how many more words the last negation reaches."""
    if symbol in (*HITS, "slur", "reported"):
        return state, "negated" if state and symbol in HITS else symbol
    return REACH if symbol == "negation" else max(0, state - 1), symbol


def target(state: int, symbol: str) -> tuple[int, str]:
    """The state holds whether a person was read, and how many more words the last threat and the last object form reach."""
    reach, person = divmod(state, 2)
    object_, threat = divmod(reach, REACH + 1)
    addressed = symbol in ("second", "object")
    written = "insult" if symbol == "slur" else symbol
    if written == "insult" and person:
        written = "insult_target"
    elif symbol == "threat" and object_ or addressed and threat:
        written = "threat_target"
    if symbol == "threat":
        threat = REACH
    elif symbol not in ("insult", "slur", "negated", "reported"):
        threat, object_ = max(0, threat - 1), REACH if symbol == "object" else max(0, object_ - 1)
    person = int(person or addressed or symbol == "target")
    return 2 * (threat + (REACH + 1) * object_) + person, written


def compose(*steps: Step) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The table of the machine that runs the transducers in a row, over all states that it can reach."""
    table, open_ = {}, [(0,) * len(steps)]
    while open_:
        states = open_.pop()
        for symbol in SYMBOLS:
            after, written = [], symbol
            for step, state in zip(steps, states, strict=True):
                state, written = step(state, written)
                after.append(state)
            table[states, symbol] = (tuple(after), written)
            if (tuple(after), SYMBOLS[0]) not in table and tuple(after) != states:
                open_.append(tuple(after))
    return table


MACHINE = compose(report, negation, target)


def readings(symbols: list[str]) -> frozenset[int]:
    """All readings of one clause and what they imply, as indices into READINGS."""
    state, found = (0, 0, 0), set()
    for s in symbols:
        state, written = MACHINE[state, s]
        found.add(written)
    if state[-1] % 2 and "insult" in found:
        found.add("insult_target")
    return frozenset(READINGS.index(x) for name in found if name in READINGS for x in (name, *IMPLIED.get(name, ())))


def _symbol(word: str, kinds: dict[str, str]) -> str:
    return kinds.get(word) or _OTHER_SYMBOLS.get(word, "other")


_OTHER_SYMBOLS = {w: kind for kind, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("second", SECONDS), ("object", OBJECTS)) for w in words}


def clause_counts(text: str, automaton: ahocorasick.Automaton) -> Counter:
    """How many clauses of the text have each reading, by its index."""
    low, counts, done = text.lower(), Counter(), -1
    hits: dict[tuple[int, int], dict[str, str]] = {}
    for end, (length, word, stem) in automaton.iter(low):
        start = end - length + 1
        if start and low[start - 1].isalpha():
            continue
        m = _WORD.match(low, start)
        kind = m and (word if m.end() == end + 1 else stem)
        if not kind:
            continue
        if start >= done:
            left = max(max(low.rfind(c, max(0, done), start) for c in ".!?;:\n\r") + 1, done)
            right = _CLAUSE_END.search(low, start)
            done = right.start() if right else len(low)
            clause = (left, done)
            hits[clause] = {}
        hits[clause][m.group()] = kind
    for (left, right), kinds in hits.items():
        counts.update(readings([_symbol(w, kinds) for w in _WORD.findall(low, left, right)]))
    return counts


def features(text: str, automaton: ahocorasick.Automaton) -> list[float]:
    """1, then for each reading 1 + log(clauses), or 0 without any."""
    counts = clause_counts(text, automaton)
    return [1.0, *(1 + math.log(counts[k]) if counts[k] else 0.0 for k in range(len(READINGS)))]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression around PRIOR by Newton's method.

    Weights of readings stay at least 0.
    """
    w = PRIOR.copy()
    ridge, low = RIDGE * np.ones(len(w)), np.r_[-np.inf, np.zeros(len(w) - 1)]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - PRIOR)
        h = (x.T * (p * (1 - p))) @ x + np.diag(ridge)
        # weights that press against 0 stay there while the others take the step
        free = ~((w <= low) & (g > 0))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        before, w = w, np.maximum(w - step, low)
        if np.abs(w - before).max() < 1e-7:
            break
    return w


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The bounded sample without most of its exact and near copies, which would pass for independent evidence.

    Of rows that agree in one of four minimum hashes of their word triples one stays: a toxic one if
    there is one, then that with the smallest hash of its text.
    """
    words = F.split(F.lower("text"), "[ \\x09-\\x0D]+")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, 3))))
    out = sample.withColumn("w", words).withColumn("h", triples)
    for k in range(4):
        out = out.withColumn(f"m{k}", F.array_min(F.transform("h", lambda x, k=k: F.xxhash64(x, F.lit(k)))))
    out = out.drop("w", "h")
    for k in range(4):
        first = Window.partitionBy(f"m{k}").orderBy(F.desc("toxic"), F.xxhash64("text"), "text")
        out = out.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")
    return out.select("text", "toxic")


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): documents of the sample that hold a word with the stem. '=' marks whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(_stem_set(text))
            stems = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([seen[1][s] for s in stems], pa.int64()), pa.array([seen[0][s] for s in stems], pa.int64())], ["stem", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(run, "stem string, toxic bigint, clean bigint")
    return counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(sample: DataFrame, max_stems: int = MAX_STEMS) -> dict[str, str]:
    """Stems and whole words that hold far more toxic documents than chance allows.

    With n documents, a share q toxic, and a base rate p, chance reaches q with probability at most
    exp(-n KL(q, p)); that has to stay under 5 % after all stems that at least three documents hold
    had their try. The `max_stems` of most gain are looked at. Stems are then taken
    greedily by the toxic documents that no seed word or earlier stem explains, if those alone beat
    chance after all stems that passed had their try: words that only occur beside an insult explain nothing and stay out. Stems whose gain is
    SURE times what chance needs are taken in any case, and a longer stem that explains nearly all
    of a shorter one takes its place. A stem that stands in THREATENING of its toxic documents as
    threats do is a threat, any other a slur.
    """
    sample = cut(_one_of_copies(sample), "toxic-distinct")
    counts = cut(_stem_counts(sample), "stems")
    total, (pos, all_) = counts.where("toxic + clean >= 3").count(), sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not pos or pos == all_:
        return {}
    rate, need = pos / all_, math.log(max(1, total)) + 3
    q = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    kl = F.when(F.col("clean") == 0, -F.log(F.lit(rate))).otherwise(q * F.log(q / rate) + (1 - q) * F.log((1 - q) / (1 - rate)))
    good = counts.where((F.col("toxic") >= 3) & (q >= 0.8)).withColumn("gain", (F.col("toxic") + F.col("clean")) * kl).where(F.col("gain") >= need)
    rows = {r["stem"]: (r["gain"], r["toxic"]) for r in good.orderBy(F.desc("gain"), "stem").limit(max_stems).collect()}
    for x in sorted(rows, key=len):
        if any(y != x and y.lstrip("=").startswith(x) and rows[y][1] >= 0.95 * rows[x][1] for y in rows):
            del rows[x]
    held: dict[str, set[int]] = {x: set() for x in rows}
    threats = Counter()
    explained: set[int] = set()
    automaton = default_grammar().automaton()
    for doc, r in enumerate(_stems_of(sample.where("toxic = 1"), frozenset(rows), automaton).collect()):
        if r["seeded"]:
            explained.add(doc)
        for x in r["stems"]:
            held[x].add(doc)
        threats.update(r["threats"])
    found: dict[str, str] = {}
    enough = math.log(max(1, len(held))) + 3
    while held:
        best = max(held, key=lambda x: (len(held[x] - explained), rows[x], x))
        own = held.pop(best)
        fresh = own - explained
        if len(fresh) * -math.log(rate) >= enough or rows[best][0] >= SURE * need:
            found[best] = "threat" if threats[best] >= THREATENING * len(own) else "slur"
            explained |= fresh
    return found


def _stem_set(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w[:n] for w in words for n in range(STEM[0], STEM[1] + 1) if len(w) > n} | {f"={w}" for w in words if len(w) >= 3}


def _threat_stems(text: str, wanted: frozenset[str]) -> set[str]:
    """The wanted stems of words that stand in a clause where a threat at a person stands."""
    found: set[str] = set()
    for clause in _CLAUSE_END.split(text.lower()):
        words = _WORD.findall(clause)
        for i, w in enumerate(words):
            own = _stem_set(w) & wanted
            if own and (OBJECTS & set(words[max(0, i - REACH) : i]) or (SECONDS | OBJECTS) & set(words[i + 1 : i + 1 + REACH])):
                found |= own
    return found


def _stems_of(sample: DataFrame, wanted: frozenset[str], seeds: ahocorasick.Automaton) -> DataFrame:
    """The wanted stems of each text, those that stand as threats, and whether the seed words already match in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            found = pa.array([sorted(_stem_set(t) & wanted) for t in texts], pa.list_(pa.string()))
            threats = pa.array([sorted(_threat_stems(t, frozenset(x))) if x else [] for t, x in zip(texts, found.to_pylist())], pa.list_(pa.string()))
            seeded = pa.array([bool(clause_counts(t, seeds)) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([found, threats, seeded], ["stems", "threats", "seeded"])

    return sample.select("text").mapInArrow(run, "stems array<string>, threats array<string>, seeded boolean")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_stems: int = MAX_STEMS) -> Grammar:
    """A grammar from labelled documents outside the held-out fold.

    The sample is the labelled rows with the smallest hash of doc_id, `sample_rows` at most. A
    document with several labels counts as toxic if one says so; null labels say nothing.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(f"toxic IS NOT NULL AND doc_id IS NOT NULL AND {crc_mod('doc_id', FOLDS)} <> 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # at most sample_rows pairs of two numbers: small enough to send to the texts
    sample = cut(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    stems = learn_stems(sample, max_stems)
    grammar = default_grammar({s: k for s, k in stems.items() if not s.startswith("=")})
    grammar.words |= {s[1:]: k for s, k in stems.items() if s.startswith("=")}
    rows = _counted(sample, grammar, ["toxic"]).groupBy("toxic", "x").count().collect()
    if rows:
        x, y, n = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), [r["count"] for r in rows]
        grammar.weights = _fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    return grammar


def _counted(docs: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """`keep` and x, the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in pieces(batches, "text"):
            x = [features(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    rows = docs.select(*keep, "text")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, predicted) per row of docs; a null text is the empty text. No shuffle."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    logit = F.expr("aggregate(zip_with(x, array(" + ",".join(f"{w!r}D" for w in grammar.weights.tolist()) + "), (a, b) -> a * b), 0D, (s, a) -> s + a)")
    scored = _counted(texts, grammar, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores under 0.5; a null text is the empty text. No shuffle."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for batch in pieces(batches, "text"):
            logit = [float(grammar.weights @ features(t, automaton)) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([x < 0 for x in logit], pa.bool_())).select([f"c{i}" for i in range(len(names))])

    kept = rows.mapInArrow(run, rows.drop("text").schema)
    return kept.toDF(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold: doc_id, held_out, score, predicted.

    Null and empty texts match nothing and get the score of the bias alone; repeated rows keep theirs,
    a null doc_id counts as the text '' for the fold. Without labels the scores are the prior's.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.expr(f"{crc_mod('doc_id', FOLDS)} = 0").alias("held_out"), "score", "predicted")
