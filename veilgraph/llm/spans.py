"""Regular-expression spans with code-point offsets, from SQL functions alone.

A match is fenced with a control character by ``regexp_replace`` and the text is
split at the fences, so pieces alternate between what lies outside and inside;
running sums of their lengths are the offsets. Running sums are taken in blocks of
about the square root of the number of pieces, which keeps long arrays cheap.
Patterns use possessive repeats and run starts, so that they take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE, STAND_IN = "\u0001", "\u0002"
SPAN = "array<struct<start:int,end:int,value:string>>"


def running(values: str, zero: str, merge) -> str:
    """SQL: for each element of the column ``values``, ``merge`` over those before it, starting at ``zero``."""
    width = f"greatest(cast(ceil(sqrt(size({values}))) as int), 1)"
    blocks = f"transform(sequence(0, cast((size({values}) - 1) / {width} as int)), k -> slice({values}, k * {width} + 1, {width}))"
    fold = lambda part, start: f"aggregate({part}, {start}, (a, x) -> {merge('a', 'x')})"
    totals = f"transform({blocks}, t -> {fold('t', zero)})"
    heads = f"transform({blocks}, (b, i) -> struct(b, {fold(f'slice({totals}, 1, i)', zero)} as h))"
    return f"""case when size({values}) > 0 then flatten(transform({heads}, q ->
        transform(q.b, (e, j) -> {fold('slice(q.b, 1, j)', 'q.h')}))) else cast(array() as array<int>) end"""


def pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after each match; the odd places (from 0) are the matches."""
    clean = F.translate(text, FENCE, STAND_IN)
    return F.split(F.regexp_replace(clean, pattern, f"{FENCE}$0{FENCE}"), FENCE, -1)


def with_spans(df, text: Column, rules, prefix="vg_"):
    """Adds for each rule (kind, pattern, hint, keep) a column ``prefix + kind`` of :data:`SPAN`.

    ``hint`` is a cheap condition without which a text can hold no match, or None;
    ``keep`` is SQL that tells from a match's text ``v`` whether it stays, or None.
    Also adds ``prefix + 'cut_' + kind``, the pieces, and ``prefix + 'at_' + kind``, where they start.
    """
    text = F.coalesce(text, F.lit(""))
    cuts = {}
    for kind, pattern, hint, _ in rules:
        cut = pieces(text, pattern)
        cuts[f"{prefix}cut_{kind}"] = cut if hint is None else F.when(hint(text), cut).otherwise(F.array(F.lit("")))
    df = df.withColumns(cuts)
    names = [k for k, *_ in rules]
    df = df.withColumns({f"{prefix}len_{k}": F.expr(f"transform({prefix}cut_{k}, p -> length(p))") for k in names})
    add = lambda a, x: f"{a} + {x}"
    df = df.withColumns(
        {f"{prefix}at_{k}": F.expr(f"case when size({prefix}cut_{k}) > 1 then {running(f'{prefix}len_{k}', '0', add)} else array(0) end") for k in names}
    )
    found = {}
    for kind, _, _, keep in rules:
        cut, at = f"{prefix}cut_{kind}", f"{prefix}at_{kind}"
        every = f"transform(sequence(1, size({cut}) - 2, 2), i -> struct(get({at}, i) as start, get({at}, i + 1) as end, get({cut}, i) as value))"
        kept = every if keep is None else f"filter({every}, s -> exists(array(s.value), v -> {keep}))"
        found[f"{prefix}{kind}"] = F.expr(f"case when size({cut}) > 2 then {kept} else cast(array() as {SPAN}) end")
    return df.withColumns(found).drop(*[f"{prefix}len_{k}" for k in names])


def shielded(df):
    """``df`` with its own columns that begin like those added here (``vg_``, ``vgp_``) under free names, and the function that gives them their names back."""
    names = {c.lower() for c in df.columns}
    away = {}
    for c in df.columns:
        if c.lower().startswith(("vg_", "vgp_")):
            free = f"own_{c}"
            while free.lower() in names:
                free = f"own_{free}"
            names.add(free.lower())
            away[c] = free
    back = {free: c for c, free in away.items()}
    order = [away.get(c, c) for c in df.columns]
    return df.withColumnsRenamed(away), lambda out: out.select(*order).withColumnsRenamed(back)


def tagged(kind: str, spans: str, order: int) -> str:
    """SQL: the spans as array<struct<start, ord, end, kind>>, which sorts by start, then by the order of kinds."""
    return f"transform({spans}, s -> struct(s.start as start, {order} as ord, s.end as end, '{kind}' as kind))"


def written(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"


def apart(spans: str, others: str) -> str:
    """SQL: those of ``spans`` that overlap none of ``others``."""
    return f"filter({spans}, s -> not exists({others}, o -> s.start < o.end and o.start < s.end))"


def replaced(df, text: str, spans: str, tag: str):
    """``df`` with every span (sorted by start) of ``text`` given as the SQL ``tag`` of ``s``; overlapping spans become the first one's tag."""
    df = df.withColumn("vg_ends", F.expr(f"transform({spans}, s -> s.end)"))
    reach = running("vg_ends", "0", lambda a, x: f"greatest({a}, {x})")
    df = df.withColumn("vg_steps", F.expr(f"zip_with({spans}, {reach}, (s, r) -> struct(s, r))"))
    parts = f"""transform(vg_steps, x -> case when x.s.start >= x.r then
        concat(substring(`{text}`, x.r + 1, x.s.start - x.r), {tag.replace('s.', 'x.s.')}) else '' end)"""
    tail = f"substring(`{text}`, coalesce(array_max(vg_ends), 0) + 1, length(`{text}`))"
    return df.withColumn(text, F.expr(f"case when size({spans}) > 0 then concat(array_join({parts}, ''), {tail}) else `{text}` end")).drop("vg_ends", "vg_steps")
