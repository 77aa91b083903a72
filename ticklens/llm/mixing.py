"""Mixing to target weights by soft membership (operator 1), DataFrame functions only.

Domains are the values of a label column of a labelled table; the query uses language and quality
of the rows that ``labels`` covers. Three steps:

* Classifier: multinomial naive Bayes over word endings (the last ``ENDING`` characters of each
  word), counted on at most ``SAMPLE_ROWS`` labelled rows and cut to the ``VOCABULARY`` most frequent
  endings, so the weight table has a proven size and is broadcast. Every document's whole text
  is scored. A document's log likelihood is scaled to at most ``EVIDENCE`` words, so that long
  documents keep soft posteriors.
* Rates: nonnegative document rates r minimise the squared relative gaps between the expected
  token totals E_d(r) = sum_i r_i tokens_i P(d | i) and the targets T_d, weighted by 1 / E_d(1), by
  accelerated projected gradient from r = 1. In the metric of the tokens the Hessian's largest eigenvalue is
  at most 1 (its rows sum to 1 because posteriors do), so step 1 always descends. An iteration is
  one aggregation that returns one number per domain; a document's rate is recomputed from the
  few gradient vectors, and the rates are written and reread every ``CUT`` iterations.
* Copies: floor(rate) plus one with the probability of the fraction, by a hash of doc_id.

The budget is the smallest total at which no domain has to shrink: over-represented domains are
balanced by repeating the others, and with a least rate of 1 (``repeated``) no document is lost. Documents without words have posteriors equal to the priors, no
tokens and rate 1. Without any labelled row there is one domain, "all". Rows are scored one by one:
a repeated doc_id is several rows (of equal texts: equal rates), a null doc_id is allowed, further
columns, whatever their names, are ignored. Whole texts are read, however long: the words of one are summed up in
its task. An empty table gives no rows. A target for a domain that was not seen in the labelled sample is an error.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import stored, text_of

ENDING = 3
VOCABULARY = 4_000
SAMPLE_ROWS = 20_000
EVIDENCE = 100.0
ITERATIONS, CUT = 40, 10
#: largest relative gap between expected and wanted tokens at which the fit ends
TOLERANCE = 1e-3
#: exponent that flattens the domains' own shares
FLATTEN = 0.7
#: labelled domains beyond this number are refused: their totals and weights go to the driver
MAX_DOMAINS = 64


def _words(text: Column) -> Column:
    return F.split(text, "\\s+")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, domain (language and quality) of a bounded sample of the labelled rows.

    A doc_id that is repeated gives one row, that of its smallest text, so the rows are as bounded as the ids.
    """
    sample = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    rows = (docs.select("doc_id", "lang", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min(F.struct("text", "lang")).alias("first")).select("first.*", "quality"))
    named = F.concat_ws("-", F.coalesce(F.col("lang"), F.lit("?")),
                        F.when(F.col("quality") == 1, "good").otherwise("poor"))
    return rows.where("trim(text) <> ''").select("text", named.alias("domain"))


def _endings(rows: DataFrame, *keep: str) -> DataFrame:
    words = rows.select(*keep, F.explode(_words(F.col("text"))).alias("w")).where("w <> ''")
    return words.select(*keep, F.substring("w", -ENDING, ENDING).alias("ending"))


class Classifier:
    """Naive Bayes weights: a small table (ending, one column per domain) and log priors."""

    def __init__(self, labelled: DataFrame):
        labelled = stored(labelled, "labelled")
        priors = labelled.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
        if len(priors) > MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} domains")
        self.domains = [r["domain"] for r in priors] or ["all"]
        total = sum(r["n"] for r in priors)
        self.priors = [r["n"] / total for r in priors] or [1.0]
        counts = _endings(labelled, "domain").groupBy("ending").agg(
            F.count("*").alias("n"), *(F.sum((F.col("domain") == d).cast("double")).alias(f"c{k}")
                                       for k, d in enumerate(self.domains)))
        top = stored(counts.orderBy(F.desc("n"), "ending").limit(VOCABULARY), "vocabulary")
        sums = top.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(len(self.domains)))).first()
        self.weights = top.select("ending", *(
            F.log((F.col(f"c{k}") + 0.5) / F.lit(sums[k] + 0.5 * VOCABULARY)).alias(f"w{k}")
            for k in range(len(self.domains))))

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """row, doc_id, n_tokens, p (array of posteriors in the order of ``domains``) of each row."""
        k = range(len(self.domains))
        rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
        # a row's words stay in its task: they are summed up there before anything is shuffled
        keyed = rows.select("row", "doc_id", F.explode(_words(F.col("text"))).alias("w"))
        keyed = keyed.select("row", "doc_id", F.when(F.col("w") != "", F.substring("w", -ENDING, ENDING)).alias("ending"))
        scored = (keyed.join(F.broadcast(self.weights), "ending", "left").groupBy("row", "doc_id")
                  .agg(F.count("ending").alias("n_tokens"), F.count("w0").alias("known"),
                       *(F.coalesce(F.sum(f"w{d}"), F.lit(0.0)).alias(f"l{d}") for d in k)))
        scale = F.lit(EVIDENCE) / F.greatest(F.col("known").cast("double"), F.lit(EVIDENCE))
        logs = scored.select("row", "doc_id", "n_tokens", *(
            (F.log(F.lit(self.priors[d])) + scale * F.col(f"l{d}")).alias(f"l{d}") for d in k))
        top = F.greatest(*(F.col(f"l{d}") for d in k)) if len(self.domains) > 1 else F.col("l0")
        shares = logs.select("row", "doc_id", "n_tokens", *(F.exp(F.col(f"l{d}") - top).alias(f"e{d}") for d in k))
        total = sum((F.col(f"e{d}") for d in k[1:]), F.col("e0"))
        return shares.select("row", "doc_id", "n_tokens", *((F.col(f"e{d}") / total).alias(f"p{d}") for d in k))


def _totals(rows: DataFrame, n: int, rate: Column) -> list[float]:
    """Expected tokens per domain under the rates; one row whatever the input's size."""
    mass = F.col("n_tokens") * rate
    row = rows.agg(*(F.coalesce(F.sum(mass * F.col(f"p{d}")), F.lit(0.0)).alias(f"t{d}") for d in range(n))).first()
    return [float(x) for x in row]


def _stepped(state: DataFrame, beta: float, move: list[float], least: float) -> DataFrame:
    """One projected gradient step of every rate from its extrapolation by ``beta``."""
    ahead = F.col("rate") + F.lit(beta) * (F.col("rate") - F.col("last"))
    change = sum((F.col(f"p{d}") * F.lit(m) for d, m in enumerate(move[1:], 1)), F.col("p0") * F.lit(move[0]))
    others = [c for c in state.columns if c not in ("rate", "last")]
    return state.select(*others, F.col("rate").alias("last"), F.greatest(F.lit(least), ahead + change).alias("rate"))


def fitted_rates(rows: DataFrame, targets: list[float], least: float = 0.0) -> DataFrame:
    """``rows`` (n_tokens, p0, p1, ...) with a column rate; ``targets``: tokens wanted per domain.

    Accelerated projected gradient: expected totals are linear in the rates, so those of the
    extrapolated rates follow from the last two and a step needs a single aggregation. Ends at
    ``TOLERANCE``, or when a step no longer changes the totals (targets out of reach, as they are for
    shrinking domains under a least rate). If neither holds after ``ITERATIONS`` steps, a warning names
    the expected and wanted tokens per domain.
    """
    n = len(targets)
    state = stored(rows.withColumn("rate", F.lit(1.0)).withColumn("last", F.lit(1.0)), "rates")
    now = before = base = _totals(state, n, F.lit(1.0))
    weight = [b if b > 0 else 1.0 for b in base]
    gap = lambda totals: max(abs(t - e) / max(t, 1.0) for t, e in zip(targets, totals))
    pace, steps = 1.0, 0
    for _ in range(ITERATIONS):
        if gap(now) <= TOLERANCE:
            break
        after = (1.0 + (1.0 + 4.0 * pace * pace) ** 0.5) / 2.0
        beta, pace = (pace - 1.0) / after, after
        ahead = [e + beta * (e - b) for e, b in zip(now, before)]
        state = _stepped(state, beta, [(t - e) / w for t, e, w in zip(targets, ahead, weight)], least)
        steps += 1
        if steps % CUT == 0:
            state = stored(state, "rates")
        before, now = now, _totals(state, n, F.col("rate"))
        if max(abs(e - b) / max(b, 1.0) for e, b in zip(now, before)) <= TOLERANCE / 20:
            break
        if gap(now) > gap(before):
            pace = 1.0                          # overshot: start the extrapolation anew
    else:
        if gap(now) > TOLERANCE:
            warnings.warn(f"rates after {ITERATIONS} steps: expected tokens {now}, wanted {targets}", stacklevel=2)
    return state.drop("last")


def balanced_targets(totals: list[float], weights: list[float]) -> list[float]:
    """Tokens per domain in the proportions ``weights``, with no domain below what it has."""
    budget = max((t / w for t, w in zip(totals, weights) if w > 0), default=0.0)
    return [budget * w for w in weights]


def default_weights(domains: list[str], totals: list[float]) -> dict[str, float]:
    """The corpus' own proportions, flattened by a power for all but the "-poor" domains."""
    top = max(totals, default=0.0) or 1.0
    wanted = [t if d.endswith("-poor") else top * (t / top) ** FLATTEN for d, t in zip(domains, totals)]
    whole = sum(wanted) or 1.0
    return {d: w / whole for d, w in zip(domains, wanted)}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None,
        least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate, copies: one row per row of ``docs``.

    ``domain`` is the likeliest domain, ``posterior`` its probability, ``copies`` the whole number
    of times the row is to be taken. ``weights`` are the wanted shares of expected tokens by domain;
    no rate falls below ``least``.
    """
    model = Classifier(labelled)
    rows = stored(model.posteriors(docs), "posteriors")
    n = len(model.domains)
    totals = _totals(rows, n, F.lit(1.0))
    weights = weights or default_weights(model.domains, totals)
    if set(weights) - set(model.domains):
        raise ValueError(f"unknown domains: {sorted(set(weights) - set(model.domains))}")
    targets = balanced_targets(totals, [weights.get(d, 0.0) for d in model.domains])
    fitted = fitted_rates(rows, targets, least)
    likeliest = F.col("p0") if n == 1 else F.greatest(*(F.col(f"p{d}") for d in range(n)))
    named = F.coalesce(*(F.when(F.col(f"p{d}") == likeliest, F.lit(name)) for d, name in enumerate(model.domains)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return fitted.select(
        "doc_id", "n_tokens", named.alias("domain"), likeliest.alias("posterior"), "rate",
        (whole + (chance < F.col("rate") - whole).cast("int")).cast("long").alias("copies"))


def repeated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say, at least once.

    Copies are looked up by doc_id. Rows with a null doc_id are taken once; where a doc_id is
    repeated, all its rows are taken as often as the likeliest of them.
    """
    copies, marks = "_copies", "_marks"
    while copies in docs.columns or marks in docs.columns:
        copies, marks = copies + "_", marks + "_"
    wanted = (mix(docs, labelled, weights, least=1.0).where("doc_id is not null").groupBy("doc_id")
              .agg(F.max("copies").alias(copies)))
    joined = docs.join(wanted.withColumnRenamed("doc_id", marks), F.col("doc_id") == F.col(marks), "left").drop(marks)
    times = F.coalesce(F.col(copies), F.lit(1)).cast("int")
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(0), times))).drop(copies)
