"""Operator 1: personal data by weak supervision, with DataFrame functions only.

Patterns give the base spans, which stay.  They and looser candidates (local numbers, spelled-out addresses, account and
insurance numbers, names after a title) are judged by five labelers: strict form, gazetteer, words before, counter-words
before, and boundaries, each voting for, against or not at all.  The votes of all candidates, counted by vote pattern, train
the reliabilities by expectation-maximisation and then a logistic span classifier on the resulting probabilities.  The
pattern counts, whose number does not depend on the data (kinds x 3^5 x length classes), are all that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import around, blocks, let, located

#: Kinds in the order of the result; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "spelled_email", "iban", "insurance", "name")
BASE = 4
#: The base patterns, written so that no start inside a run is tried twice and no repetition recurses.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,6}",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
)
#: What a text must hold for a pattern to be tried at all.
NEEDS = ("@", "[0-9]", "[0-9]", r"\+[0-9]", "[0-9]{4}", r"[(\[]at[)\]]", "[A-Z]{2}[0-9]{2}", "[0-9]-[0-9]", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}")
#: Gazetteers: what a span of the kind starts or ends with (fixed values).
KNOWN = (
    r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|ch|at|eu|us)$",
    r"^(?!0\.|127\.|255\.|224\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    r"^\(?[2-9][0-9]{2}",
    r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$",
    r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    r"^(?!000|666|9)",
    r" (?:Smith|Johnson|Brown|Taylor|Miller|Davis|Wilson|Schmidt|Weber|Fischer|Meyer|Martin|Bernard|Dubois|Laurent|Garcia|Lopez|Perez|Sanchez|Fernandez)$",
)
CONTEXT = (
    r"e-?mail|contact|write to|correo|courriel",
    r"\bip\b|address|host|server",
    r"card|visa|mastercard|credit|karte|carte|tarjeta",
    r"phone|tel|call|mobile|fax",
    r"phone|tel|call|mobile|fax",
    r"e-?mail|contact|write to|correo|courriel",
    r"iban|account|konto|compte|cuenta",
    r"ssn|social security",
    r"name|dear|signed|contact",
)
COUNTER = r"version|isbn|order|invoice|part no|build|release|serial|item"
LABELERS = 5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: int, found: Column) -> Column:
    """What a match of a base kind must fulfil besides its pattern."""
    if kind == 1:
        short = F.transform(F.split(found, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == 2:
        return let(_digits(found), lambda d: F.length(d).between(16, 19) & F.coalesce(_luhn(F.when(F.length(d).between(16, 19), d)), F.lit(False)))
    if kind == 3:
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _votes(kind: int, cut: Column, m: Column) -> Column:
    """The labelers' votes on a match, from the text's blocks."""
    before = F.lower(around(cut, m["start"], 40, 0))
    strict = _valid(kind, m["found"]) if kind < BASE else F.length(_digits(m["found"])).between(*((10, 11), (0, 99), (12, 34), (9, 9), (0, 0))[kind - BASE])
    edges = F.concat(around(cut, m["start"], 1, 0), F.lit(" "), around(cut, m["end"], 0, 1))
    yes, no, skip = F.lit(1), F.lit(-1), F.lit(0)
    return F.array(
        F.when(strict, yes).otherwise(no),
        F.when(m["found"].rlike(KNOWN[kind]), yes).otherwise(no),
        F.when(before.rlike(CONTEXT[kind]), yes).otherwise(skip),
        F.when(before.rlike(COUNTER), no).otherwise(skip),
        F.when(edges.rlike(r"[\p{L}\p{N}_]"), no).otherwise(yes),
    )


EMPTY = "array<struct<kind:int,start:int,end:int,votes:array<int>,size:int>>"


def candidates(text: Column) -> Column:
    """array<struct<kind,start,end,votes,size>>: the valid base spans, then the looser candidates, by kind and start."""

    def of(kind: int) -> Column:
        found = located(text, PATTERNS[kind])
        if kind < BASE:
            found = F.filter(found, lambda m: _valid(kind, m["found"]))
        told = let(
            blocks(text),
            lambda cut: F.transform(
                found,
                lambda m: F.struct(
                    F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _votes(kind, cut, m).alias("votes"), F.least((m["end"] - m["start"]) / 5, F.lit(7)).cast("int").alias("size")
                ),
            ),
        )
        return F.when(text.rlike(NEEDS[kind]), told).otherwise(F.array().cast(EMPTY))

    return F.concat(*[of(k) for k in range(len(KINDS))])


@dataclass
class SpanModel:
    """Log-odds of a span: bias, by kind, by each labeler's vote (against, none, for), by length class."""

    bias: float
    kind: list[float]
    vote: list[list[float]]
    size: list[float]
    reliability: list[float]

    def score(self, c: Column) -> Column:
        table = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
        total = F.lit(self.bias) + table(self.kind, c["kind"]) + table(self.size, c["size"])
        for k in range(LABELERS):
            total = total + table(self.vote[k], F.element_at(c["votes"], k + 1) + 1)
        return total


def train(patterns: list[tuple[int, list[int], int, int]], rounds: int = 100) -> SpanModel:
    """EM over (kind, votes, size, count) patterns, then logistic regression on its probabilities."""
    if not patterns:
        return SpanModel(0.0, [0.0] * len(KINDS), [[-1.0, 0.0, 1.0]] * LABELERS, [0.0] * 8, [0.5] * LABELERS)
    patterns = sorted(patterns, key=lambda p: (p[0], p[1], p[2]))
    kind, votes = np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns]) + 1
    size, count = np.array([p[2] for p in patterns]), np.array([p[3] for p in patterns], float)
    p = 1 / (1 + np.exp(-(votes - 1).sum(1).astype(float)))  # majority to begin with
    for _ in range(rounds):
        prior = np.array([[(count * q * (kind == k)).sum() + 1 for k in range(len(KINDS))] for q in (1 - p, p)])
        log = np.log(prior)[:, kind] - np.log(prior.sum(0))[kind]
        for k in range(LABELERS):
            seen = np.array([[(count * q * (votes[:, k] == v)).sum() + 1 for v in range(3)] for q in (1 - p, p)])
            log = log + np.log(seen / seen.sum(1, keepdims=True))[:, votes[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    if (count * p).sum() < (count * ((votes - 1).sum(1) > 0)).sum() / 2:  # the classes' names were swapped
        p = 1 - p if np.corrcoef(p, (votes - 1).sum(1))[0, 1] < 0 else p
    reliability = [float((count * np.where(votes[:, k] == 2, p, np.where(votes[:, k] == 0, 1 - p, 0))).sum() / max(1.0, (count * (votes[:, k] != 1)).sum())) for k in range(LABELERS)]
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, k]] for k in range(LABELERS)), np.eye(8)[size], np.ones((len(count), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge; few enough columns to solve at once
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (count * (q - p)) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    at, w = len(KINDS), w.tolist()
    return SpanModel(w[-1], w[:at], [w[at + 3 * k : at + 3 * k + 3] for k in range(LABELERS)], w[at + 3 * LABELERS : -1], reliability)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """The span model of all candidates in df: one scan, one count by vote pattern."""
    found = common.texts(df, id_col, text_col).select(F.explode(candidates(F.col("text"))).alias("c"))
    counts = found.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.size").alias("size")).agg(F.count("*").alias("n"))
    return train([(r.kind, list(r.votes), r.size, r.n) for r in counts.collect()])


def spans(text: Column, model: SpanModel) -> Column:
    """array<struct<kind,start,end>>: all base spans, and those others that the classifier accepts and that overlap no earlier kind."""

    def chosen(all_: Column) -> Column:
        good = F.filter(all_, lambda c: (c["kind"] < BASE) | (model.score(c) > 0))
        return let(good, lambda g: F.filter(g, lambda c: (c["kind"] < BASE) | ~F.exists(g, lambda x: (x["kind"] < c["kind"]) & (x["start"] < c["end"]) & (c["start"] < x["end"]))))

    return F.transform(let(candidates(text), chosen), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def find_personal_data(df: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more) for every row.

    Spans are kind:start:end in code points, end exclusive.  A null or empty text has none; a null id stays null; repeated
    rows give repeated results; further columns are not read; an empty table gives an empty result; bytes that are no UTF-8 count
    as U+FFFD, in places too.
    """
    model = model or fit(df, id_col, text_col)
    name = lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    found = common.texts(df, id_col, text_col).select("doc_id", spans(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(F.array_join(F.transform(F.filter("found", lambda s: s["kind"] < BASE), name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", name), ",").alias("spans"),
        F.size(F.filter("found", lambda s: s["kind"] >= BASE)).cast("long").alias("n_more"),
    )


def masked(df: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each span of its texts replaced by [KIND]; overlapping spans become one.  A null text stays null; n_chars, if there, follows.

    All columns stay, in their order; repeated rows and rows without an id are treated each; an empty table stays empty.
    """
    model = model or fit(df, id_col, text_col)
    text = F.col(text_col)
    ordered = F.array_sort(F.transform(spans(text, model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        lead = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(lead, tag))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = df.withColumn(text_col, F.when(text.isNotNull(), whole))
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in df.columns else out
