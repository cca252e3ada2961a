"""Secret scans: base patterns, then two character Markov models (DataFrame operations only).

Runs of 16 or more key characters are scored by the log-likelihood ratio of two
first-order Markov models: one of random strings, one of ordinary identifiers.
Both are trained from labelled strings of a bounded sample of documents
(``SAMPLE_DOCS``, the ids with the lowest digests): what the base patterns find
is labelled random, every other run of ``LEAST_WORD`` or more characters that stands in two of them is labelled ordinary.
A run is a secret if the ratio is positive on average and reaches ``LIMIT``.

Defined results: null text is empty; without labelled strings both models are
uniform and add nothing; found runs that overlap a base span are not repeated;
repeated rows are each done alike; an empty table gives an empty result; extra
columns pass through :func:`redact` whatever their names (:func:`detect` adds columns that start with ``vg_``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S

KINDS = ("assign", "access", "hex")
MARKOV = "markov"
SAMPLE_DOCS, LEAST_WORD, LIMIT, BACK_OFF = 2000, 5, math.log(1e4), 4.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
VALUE = r"[A-Za-z0-9+/_.=-]"

ASSIGNED = r"""r"^(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)$" """

RULES = (
    (
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++",
        lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")),
        rf"length(regexp_extract(v, {ASSIGNED}, 1)) >= 12",
    ),
    ("access", r"AKIA[A-Z0-9]{14,}+", lambda t: F.contains(t, F.lit("AKIA")), None),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", None, None),
)
RUN = ((MARKOV, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+", None, None),)


def labelled_strings(docs: DataFrame, text="text", sample=SAMPLE_DOCS) -> DataFrame:
    """value, random: labelled strings of the sampled documents."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")
    found = S.with_spans(few, F.col("t"), RULES)
    secrets = F.expr(f"""concat(transform(vg_assign, s -> regexp_extract(s.value, {ASSIGNED}, 1)),
        transform(vg_access, s -> s.value), transform(vg_hex, s -> s.value))""")
    runs = F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]{%d,}+" % LEAST_WORD), F.lit(0))
    both = found.select(secrets.alias("secrets"), F.array_distinct(F.array_except(runs, secrets)).alias("words"))
    # explode_outer, as explode would have the optimizer repeat the whole span search in a filter
    random = both.select(F.explode_outer("secrets").alias("value")).filter("value is not null").distinct()
    words = both.select(F.explode_outer("words").alias("value")).filter("value is not null").groupBy("value").count().filter("count > 1")
    return random.select("value", F.lit(True).alias("random")).union(words.select("value", F.lit(False)))


def train(strings: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of neighbouring characters, by row."""
    k = len(ALPHABET)
    # a value is split into characters once, so that long ones take linear time
    chars = F.split("value", "")
    pair = F.explode(F.zip_with(F.slice(chars, 1, F.length("value") - 1), F.slice(chars, 2, F.length("value") - 1), lambda a, b: F.concat(a, b)))
    pairs = strings.filter(F.length("value") > 1).select("random", pair.alias("pair"))
    pairs = pairs.filter(F.regexp_like("pair", F.lit("^[A-Za-z0-9+/_=-]{2}$")))
    counts = {True: [[0.0] * k for _ in range(k)], False: [[0.0] * k for _ in range(k)]}
    for row in pairs.groupBy("random", "pair").count().collect():  # at most 2 k * k rows
        counts[row["random"]][ALPHABET.index(row["pair"][0])][ALPHABET.index(row["pair"][1])] += row["count"]
    chance = {c: _smoothed(m) for c, m in counts.items()}
    return [round(a - b, 4) for ra, rb in zip(chance[True], chance[False]) for a, b in zip(ra, rb)]


def _smoothed(counts: list[list[float]]) -> list[list[float]]:
    """Logarithms of P(next | this), backed off with weight ``BACK_OFF`` to how often a character comes next at all."""
    n = sum(map(sum, counts))
    single = [(sum(line[j] for line in counts) + 0.5) / (n + 0.5 * len(counts)) for j in range(len(counts))]
    return [[math.log((x + BACK_OFF * p) / (sum(line) + BACK_OFF)) for x, p in zip(line, single)] for line in counts]


def ratio(value: str, table: list[float]) -> str:
    """SQL: the log-likelihood ratio of a string of :data:`ALPHABET`'s characters, which is split into characters once."""
    array = lambda values, kind: f"cast(split('{','.join(f'{x:g}' for x in values)}', ',') as array<{kind}>)"  # noqa: E731  a constant for the optimizer
    place = array([ALPHABET.find(chr(i)) for i in range(128)], "int")
    at = lambda i: f"get({place}, ascii(get(c, {i})))"
    cell = f"get({array(table, 'double')}, {at('i - 1')} * {len(ALPHABET)} + {at('i')})"
    total = f"aggregate(sequence(1, size(c) - 1), cast(0 as double), (t, i) -> t + coalesce({cell}, cast(0 as double)))"
    return f"aggregate(array(split({value}, '')), cast(0 as double), (u, c) -> u + {total})"


def detect(docs: DataFrame, text="text", table: list[float] | None = None, limit=LIMIT) -> DataFrame:
    """``docs`` with vg_assign, vg_access, vg_hex and vg_markov spans."""
    table = train(labelled_strings(docs, text)) if table is None else table
    found = S.with_spans(docs, F.col(text), (*RULES, *RUN))
    free = S.apart(f"vg_{MARKOV}", f"concat({', '.join(f'vg_{k}' for k in KINDS)})")
    kept = F.expr(f"case when size(vg_{MARKOV}) > 0 then filter({free}, s -> {ratio('s.value', table)} >= {limit}) else vg_{MARKOV} end")
    kinds = [k for k, *_ in (*RULES, *RUN)]
    return found.withColumn(f"vg_{MARKOV}", kept).drop(*[f"vg_{part}_{k}" for part in ("cut", "at") for k in kinds])


def _sorted(kinds) -> str:
    return f"array_sort(concat({', '.join(S.tagged(k, f'vg_{k}', i) for i, k in enumerate(kinds))}))"


def redact(docs: DataFrame, text="text", **rules) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind."""
    plain, named = S.shielded(docs)
    found = detect(plain, text, **rules).withColumn("vg_all", F.expr(_sorted((*KINDS, MARKOV))))
    return named(S.replaced(found, text, "vg_all", "concat('[', upper(s.kind), ']')"))


def op3(docs: DataFrame) -> DataFrame:
    found = detect(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"vg_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(S.written(_sorted(KINDS))), 256).alias("base_sha256"),
        F.expr(S.written(_sorted((*KINDS, MARKOV)))).alias("spans"),
        F.size(f"vg_{MARKOV}").cast("long").alias("n_markov"),
    )
