"""License scan: ordered regex signatures with keyword gates and interval suppression.

Everything is a built-in expression over one row: no shuffle, no Python.  Per
text: normalise to words, test cheap anchors, keep the rules whose own keyword
occurs, find every match of those with its word interval, then sweep the
intervals once and drop each that lies inside one of equal or higher priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules

DETECTION = "struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string,base:boolean>"
#: Arrays grown in a fold are cut into pieces of this length, so a fold over n detections copies O(n) items.
PIECE = 256
LEVELS = (1, 2, 3, 4)
#: A character that no normalised text has; it marks matches.
OPEN = "\\u0001"
#: Rules that share a first branch.
BRANCH = 16


def normalised(text: Column) -> Column:
    """Lower-case words joined and surrounded by single spaces; a single space where there is no word."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(F.lower(spaced)), F.lit(" "))


def _spaces(s: str) -> str:
    return f"(octet_length({s}) - octet_length(replace({s}, ' ', '')))"


def _pushed(item: str, kind: str, held: str = "a") -> str:
    """SQL of the fields ``cur`` and ``done`` after ``item`` is appended, in pieces."""
    return (
        f"'cur', if(size({held}.cur) >= {PIECE}, array({item}), concat({held}.cur, array({item}))), "
        f"'done', if(size({held}.cur) >= {PIECE}, concat({held}.done, array({held}.cur)), {held}.done)"
    )


def _empty(kind: str) -> str:
    return f"'cur', cast(array() as array<{kind}>), 'done', cast(array() as array<array<{kind}>>)"


def _pieces(norm: str, rules: list[dict]) -> str:
    """SQL: ``norm`` cut before and after each match of rule ``r``; every second piece is a match.

    Each rule's expression stands in the plan as a literal, so it is compiled
    once for a task; tens of rules share a first branch.
    """

    def cut(rule: dict) -> str:
        regex = rule["regex"].replace("\\", "\\\\").replace("'", "\\'")
        return f"regexp_replace({norm}, '{regex}', '{OPEN}$0{OPEN}')"

    def chosen(numbers: range, found: list[str]) -> str:
        return "case r.rule " + " ".join(f"when {i} then {found[i]}" for i in numbers) + " end"

    found = [cut(r) for r in rules]
    groups = [range(at, min(at + BRANCH, len(rules))) for at in range(0, len(rules), BRANCH)]
    marked = f"case int(r.rule div {BRANCH}) " + " ".join(f"when {k} then {chosen(g, found)}" for k, g in enumerate(groups)) + " end" if groups else norm
    return f"split({marked}, '{OPEN}', -1)"


def _matches(norm: str, rules: list[dict]) -> str:
    """SQL: the detections of rule ``r`` in ``norm``, in order; spaces in the pieces before a match give the number of words before it."""
    match, before = "element_at(p, 2 * i)", "element_at(p, 2 * i - 1)"
    item = (
        f"struct(int(a.at + {_spaces(before)}) as start, int(-(a.at + {_spaces(before)} + {_spaces(match)})) as neg_end, "
        "int(-r.priority) as neg_priority, r.rule as rule, r.label as label, r.base as base)"
    )
    step = f"named_struct('at', int(a.at + {_spaces(before)} + {_spaces(match)}), {_pushed(item, DETECTION)})"
    fold = (
        f"aggregate(sequence(1, int(size(p) div 2)), named_struct('at', 0, {_empty(DETECTION)}), (a, i) -> {step}, "
        "a -> concat(flatten(a.done), a.cur))"
    )
    # A one-element array binds the pieces to a name.
    return f"flatten(transform(array({_pieces(norm, rules)}), p -> if(size(p) < 2, cast(array() as array<{DETECTION}>), {fold})))"


def _sweep(found: str) -> str:
    """SQL: ``found`` sorted by (start, longer, priority, rule) without the contained ones.

    Whatever contains a detection comes before it in this order, so it is
    suppressed exactly if an earlier one of its priority or a higher one ends
    no sooner.  Base detections always stay.
    """
    inside = " or ".join(f"(a.m{p} >= -d.neg_end and {p} >= -d.neg_priority)" for p in LEVELS)
    reach = ", ".join(f"'m{p}', if(-d.neg_priority = {p}, greatest(a.m{p}, -d.neg_end), a.m{p})" for p in LEVELS)
    kept = _pushed("d", DETECTION)
    same = "'cur', a.cur, 'done', a.done"
    step = f"if(({inside}) and not d.base, named_struct({reach}, {same}), named_struct({reach}, {kept}))"
    start = ", ".join(f"'m{p}', -1" for p in LEVELS)
    return (
        f"aggregate(array_sort({found}), named_struct({start}, {_empty(DETECTION)}), (a, d) -> {step}, "
        "a -> concat(flatten(a.done), a.cur))"
    )


def _rule_array(rules: list[dict]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(i).alias("rule"), F.lit(r["label"]).alias("label"), F.lit(r["priority"]).alias("priority"),
                F.lit(r["keyword"]).alias("keyword"), F.lit(r["base"]).alias("base"),
            )
            for i, r in enumerate(rules)
        )
    )


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "license", rules: list[dict] | None = None) -> DataFrame:
    """Add struct ``out_col`` with the license evidence of each text.

    Fields: ``n_words``, ``detections`` (kept ones, in order: label, rule
    number, priority, first word, end word, base), ``n_base``, ``first_word``,
    ``last_word`` (smallest and largest start of a base phrase, null if none),
    ``base_labels``, ``labels`` (sorted, distinct) and ``score``, the noisy-or
    of the kept labels' priorities over 5.

    Null, empty or wordless text: no words, no detections, score 0.  Rows are
    independent, so ties and repeated rows give equal results and an empty
    table gives no rows; all other columns pass through, except that one
    named like ``out_col`` is replaced.  Memory and time are linear in the
    text and its detections.
    """
    rules = license_rules.rules() if rules is None else rules
    gate = None
    for word in license_rules.ANCHORS:
        gate = F.col("_n").contains(word) if gate is None else gate | F.col("_n").contains(word)
    hits = "filter(_rules, r -> contains(_n, r.keyword))"
    found = f"flatten(transform({hits}, r -> {_matches('_n', rules)}))"
    evidence = F.expr(f"if(_hit, {_sweep(found)}, cast(array() as array<{DETECTION}>))")
    base = "filter(_d, d -> d.base)"
    names = "array_sort(array_distinct(transform({}, d -> d.label)))"
    out = F.expr(
        f"""named_struct(
            'n_words', cast(greatest({_spaces('_n')} - 1 - int(_n = '  '), 0) as bigint),
            'detections', transform(_d, d -> named_struct('label', d.label, 'rule', d.rule, 'priority', -d.neg_priority,
                'first_word', d.start, 'end_word', -d.neg_end, 'base', d.base)),
            'n_base', cast(size({base}) as bigint),
            'first_word', cast(array_min(transform({base}, d -> d.start)) as bigint),
            'last_word', cast(array_max(transform({base}, d -> d.start)) as bigint),
            'base_labels', {names.format(base)},
            'labels', {names.format('_d')},
            'score', 1D - aggregate({names.format('_d')}, 1D, (s, l) ->
                s * (1D - array_max(transform(filter(_d, d -> d.label = l), d -> -d.neg_priority)) / 5D)))"""
    )
    kept = [c for c in docs.columns if c != out_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), normalised(F.col(text_col)).alias("_n"))
    return (
        packed.withColumn("_hit", gate)
        .withColumn("_rules", _rule_array(rules))
        .withColumn("_d", evidence)
        .select("_row", out.alias("_out"))
        .select("_row.*", F.col("_out").alias(out_col))
    )
