"""Personal data: generators propose spans, boosted trees choose among them. SQL functions only.

Fixed formats (email, ip, card, phone) are always reported. Further generators propose spans with
high recall: local phone numbers, social security numbers, IBANs, birth dates, MAC and IPv6
addresses, spelt-out emails, titled names, street addresses, document numbers and credentials in
URLs. Each candidate gets features of its format and of the words around it; gradient-boosted
trees (trained on made-up sentences, see ``pii_training``) score it, and a margin calibrated for
each generator decides. Candidates that overlap a fixed format are dropped. Of accepted candidates
that overlap, the best stays, then the best of those that don't overlap it, and so on.

Positions come from splitting a text at a pattern's matches: piece and match lengths add up to
code point offsets. Overlaps are found by running totals over spans sorted by start, so that the time
is in proportion to the number of spans (to the square only of the longest chain of accepted
candidates that overlap one another).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_training

BASE = ["email", "ip", "card", "phone"]

#: The fixed formats. A match can only start where its first run of characters starts or where the
#: last match ended, which keeps long runs linear.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a pattern to be tried.
BASE_GATES = {"email": "contains(t, '@')", "ip": "digits", "card": "digits", "phone": "contains(t, '+')"}

#: Generators: name, gate, pattern.
GENERATORS = [
    ("phone_local", "digits", r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?[\x20.-]?[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    ("ssn", "digits", r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])"),
    ("iban", "digits", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("birth_date", "digits", r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?![0-9./-])"),
    ("mac", "contains(t, ':')", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
    ("ipv6", "contains(t, ':')", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}(?![0-9A-Fa-f:])"),
    ("email_spelt", "t rlike '(?i)[(\\\\[]at[)\\\\]]|\\\\x20at\\\\x20'", r"(?i)(?<![A-Z0-9._-])[A-Z0-9._-]{2,40}(?:\x20at\x20|\x20?[(\[]at[)\]]\x20?)[A-Z0-9-]{2,40}(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?|\.)[A-Z]{2,6}(?![A-Z0-9])"),
    ("name", "t rlike '(?:Mrs?|Ms|Dr|Herr|Frau|Sra?|Mme)[.]?\\\\x20\\\\p{Lu}'", r"(?<![\p{L}\p{N}])(?:Mrs?|Ms|Dr|Herr|Frau|Sra?|Mme)\.?\x20\p{Lu}[\p{L}'-]{1,30}(?:\x20\p{Lu}[\p{L}'-]{1,30})?"),
    ("street", "digits", r"(?<![0-9A-Za-z])[0-9]{1,5}\x20\p{Lu}\p{L}{1,20}(?:\x20\p{Lu}\p{L}{1,20})?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square)(?![A-Za-z])"),
    ("document", "digits", r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,9}(?![0-9A-Za-z])"),
    ("credential", "contains(t, '://')", r"https?://[^\s/@:]{1,64}:[^\s/@]{1,64}@"),
]

#: Words whose presence shortly before a candidate is a feature, as groups.
CONTEXTS = [
    "phone|mobile|tel|call|fax|reach|telefon|teléfono|téléphone",
    "ssn|social",
    "iban|account|transfer|bank",
    "born|birth|dob|birthday|geboren|nacid|née?",
    "mac|device|host|ip",
    "write|contact|mail|email",
    "passport|license number|id number|ausweis|pasaporte",
    "address|lives|ship|street",
    "order|invoice|ticket|case|item|part|model|sku|flight|isbn|ref|code|key",
    "version|release|build|commit|digest|page|row|score|ratio|total|price|population|number|value|draw",
    "said|regards|dear|by|from",
]
FEATURE_NAMES = [
    "kind", "n_chars", "n_digits", "n_upper", "n_spaces", "n_dashes", "n_dots", "n_colons", "n_slashes", "n_parens", "n_groups", "first",
    *[f"c{k}" for k in range(len(CONTEXTS))], "after_word",
]

CONTEXT_CHARS = 40


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, step: str, start: str) -> str:
    """Running results of ``step`` (of x.n and v) over an array of longs; blocks of 256 keep copying low."""
    made = "named_struct('n', r, 'out', concat(x.out, array(r)))"
    block = (
        "aggregate(slice(a, b + 1, 256), named_struct('n', acc.n, 'out', cast(array() as array<bigint>)),"
        f" (x, v) -> {let(step, 'r', made)})"
    )
    grown = let(block, "q", "named_struct('n', q.n, 'out', concat(acc.out, q.out))")
    return let(
        array,
        "a",
        "if(size(a) = 0, cast(array() as array<bigint>), aggregate(sequence(0, size(a) - 1, 256),"
        f" named_struct('n', {start}, 'out', cast(array() as array<bigint>)), (acc, b) -> {grown}, acc -> acc.out))",
    )


def sums(array: str) -> str:
    """Running totals of an array of numbers, each with its own element."""
    return running(array, "x.n + v", "0L")


def highest(array: str) -> str:
    return running(array, "if(v > x.n, v, x.n)", "-1L")


SPAN = "array<struct<kind:int,start:bigint,end:bigint,text:string,left:string,right:string>>"


def found(pattern: str, kind: int, gate: str) -> str:
    """The matches of a pattern in ``t`` as SPAN."""
    lengths = "transform(v.h, (m, k) -> cast(length(v.p[k]) + length(m) as bigint))"
    spans = let(
        f"named_struct('p', v.p, 'h', v.h, 'e', {sums(lengths)})",
        "u",
        f"transform(u.h, (m, k) -> named_struct('kind', {kind}, 'start', u.e[k] - length(m), 'end', u.e[k], 'text', m,"
        f" 'left', right(u.p[k], {CONTEXT_CHARS}), 'right', left(u.p[k + 1], 12)))",
    )
    body = let(f"named_struct('p', split(t, {literal(pattern)}, -1), 'h', regexp_extract_all(t, {literal(pattern)}, 0))", "v", spans)
    return f"if({gate}, {body}, cast(array() as {SPAN}))"


DIGITS_OF = "regexp_replace(x.text, '[^0-9]', '')"
LUHN = (
    "aggregate(transform(split(reverse(d), ''), (c, k) -> if(k % 2 = 0, cast(c as int), if(c >= '5', 2 * cast(c as int) - 9, 2 * cast(c as int)))),"
    " 0, (a, v) -> a + v) % 10 = 0"
)
BASE_TESTS = {
    "email": "true",
    "ip": "forall(split(x.text, '[.]'), o -> length(ltrim('0', o)) <= 3 and cast(concat('0', ltrim('0', o)) as int) <= 255)",
    "card": let(DIGITS_OF, "d", f"if(length(d) between 14 and 19, {LUHN}, false)"),
    "phone": let(DIGITS_OF, "d", "length(d) between 10 and 15"),
}


def base_spans() -> str:
    parts = [
        f"filter({found(BASE_PATTERNS[k], n, BASE_GATES[k])}, x -> {BASE_TESTS[k]})" for n, k in enumerate(BASE)
    ]
    return f"concat({', '.join(parts)})"


def candidate_spans() -> str:
    return "concat(" + ", ".join(found(p, n, gate) for n, (_, gate, p) in enumerate(GENERATORS)) + ")"


def feature_struct() -> str:
    """The features of a candidate x as a struct of doubles."""

    def count(chars: str) -> str:
        return f"length(x.text) - length(translate(x.text, '{chars}', ''))"

    values = {
        "kind": "x.kind", "n_chars": "length(x.text)", "n_digits": f"length({DIGITS_OF})",
        "n_upper": r"length(regexp_replace(x.text, '[^\\p{Lu}]', ''))", "n_spaces": count(" "), "n_dashes": count("-"), "n_dots": count("."),
        "n_colons": count(":"), "n_slashes": count("/"), "n_parens": count("()"), "n_groups": "size(split(x.text, '[^0-9A-Za-z]+'))",
        "first": "length(regexp_extract(x.text, '^[^0-9A-Za-z]*([0-9A-Za-z]+)', 1))", "after_word": r"if(x.right rlike '^\\x20?\\p{L}', 1, 0)",
    }
    for k, words in enumerate(CONTEXTS):
        values[f"c{k}"] = rf"if(x.left rlike '(?i)(?<!\\p{{L}})(?:{words})[^\\p{{L}}]{{0,3}}(?:\\p{{L}}{{1,6}}[^\\p{{L}}]{{1,2}}){{0,2}}$', 1, 0)"
    return "named_struct(" + ", ".join(f"'{n}', cast({values[n]} as double)" for n in FEATURE_NAMES) + ")"


def tree_sql(tree: dict) -> str:
    if "leaf" in tree:
        return f"{tree['leaf']!r}D"
    return f"if(f.{FEATURE_NAMES[tree['feature']]} <= {tree['at']!r}D, {tree_sql(tree['low'])}, {tree_sql(tree['high'])})"


def _model(candidates: list[tuple]) -> tuple[str, dict[int, float]]:
    x = np.array([c[2:] for c in candidates], float)
    y = np.array([c[1] for c in candidates], float)
    trees, start, margins = pii_training.fit(x, y, np.array([c[0] for c in candidates]))
    return " + ".join([f"{start!r}D", *map(tree_sql, trees)]), margins


_trained: list = []


def trained(spark: SparkSession) -> tuple[str, dict[int, float]]:
    """The trees' sum as SQL over a struct f, and the margin of each generator. Fitted once a process."""
    if not _trained:
        rows = spark.createDataFrame(pii_training.sentences(), "id int, t string, from_ int, to_ int")
        got = (
            rows.withColumn("digits", F.expr("t rlike '[0-9]'"))
            .withColumn("x", F.explode(F.expr(candidate_spans())))
            .withColumn("f", F.expr(feature_struct()))
            .selectExpr("id", "x.kind as k", "x.start as s", "int(x.start < to_ and x.end > from_ and x.end - x.start >= 0.6 * (to_ - from_)) as y", "f.*")
            .orderBy("id", "k", "s")
            .collect()
        )
        _trained.append(_model([(r[1], r[3], *tuple(r)[4:]) for r in got]))
    return _trained[0]


#: A position beyond all texts.
FAR = 1 << 40


def free_of(base: str, cand: str) -> str:
    """The candidates that overlap no base span.

    With both sorted by start, one overlaps a span from before if the highest end so far is beyond its
    start, and one from behind if the next start is before its end.
    """
    both = (
        f"sort_array(concat(transform({base}, b -> named_struct('start', b.start, 'c', 0, 'end', b.end, 'x', cast(null as {SPAN[6:-1]}))),"
        f" transform({cand}, x -> named_struct('start', x.start, 'c', 1, 'end', x.end, 'x', x))))"
    )
    ends = highest("transform(s, y -> if(y.c = 0, y.end, -1L))")
    starts = f"reverse({highest(f'reverse(transform(s, y -> if(y.c = 0, {FAR}L - y.start, -1L)))')})"
    kept = "filter(z.s, (y, k) -> y.c = 1 and z.e[k] <= y.start and (z.f[k] < 0 or " + f"{FAR}L - z.f[k] >= y.end))"
    return let(both, "s", let(f"named_struct('s', s, 'e', {ends}, 'f', {starts})", "z", f"transform({kept}, y -> y.x)"))


def best_of(good: str) -> str:
    """Of overlapping spans the best, then the best of those that don't overlap it, and so on, by start.

    Spans are cut into chains where no earlier one reaches the next start; most chains are one span.
    """
    ends = highest("transform(s, y -> y.end)")
    firsts = "filter(sequence(0, size(s) - 1), k -> k = 0 or z.e[k - 1] <= s[k].start)"
    chain = "slice(s, k + 1, coalesce(get(i, j + 1), size(s)) - k)"
    kind = "array<struct<start:bigint,end:bigint,kind:int,z:double>>"
    ranked = "sort_array(transform(c, y -> named_struct('z', -y.z, 'start', y.start, 'end', y.end, 'kind', y.kind)))"
    fits = "forall(a, o -> o.end <= y.start or y.end <= o.start)"
    picked = (
        f"aggregate({ranked}, cast(array() as {kind}),"
        f" (a, y) -> if({fits}, concat(a, array(named_struct('start', y.start, 'end', y.end, 'kind', y.kind, 'z', -y.z))), a))"
    )
    chains = let(firsts, "i", f"transform(i, (k, j) -> {let(chain, 'c', f'if(size(c) = 1, c, {picked})')})")
    body = let(f"named_struct('e', {ends})", "z", f"sort_array(flatten({chains}))")
    return let(
        f"sort_array(transform({good}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'z', x.z)))",
        "s",
        f"if(size(s) = 0, cast(array() as {kind}), {body})",
    )


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more: one row for each row of docs.

    Null and empty texts have no spans; repeated rows stay repeated, and a null doc_id stays null. ``spans`` holds kind:start:end of the fixed formats and of
    the accepted candidates, by start, then kind.
    """
    score, margins = trained(spark)
    accepted = " or ".join(f"(x.kind = {k} and x.z >= {m!r}D)" for k, m in sorted(margins.items())) or "false"
    names = ", ".join(f"'{g[0]}'" for g in GENERATORS)
    named = f"element_at(array('email', 'ip', 'card', 'phone', {names}), s.kind + 1)"
    text = f"array_join(transform(%s, s -> concat({named}, ':', s.start, ':', s.end)), ',')"
    plain = "transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end))"
    scored = f"transform(cand, x -> {let(feature_struct(), 'f', f'''named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'z', {score})''')})"
    free = free_of("base", "cand")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("digits", F.expr("t rlike '[0-9]'"))
    d = d.select("doc_id", F.expr(base_spans()).alias("base"), F.expr(candidate_spans()).alias("cand"))
    d = d.withColumn("cand", F.expr(f"if(size(cand) = 0, cand, {free})"))
    d = d.withColumn("good", F.expr(f"filter({scored}, x -> {accepted})"))
    d = d.withColumn("more", F.expr(best_of("good")))
    d = d.withColumn("first", F.expr(f"array_sort({plain})"))
    d = d.withColumn(
        "all", F.expr(f"array_sort(concat({plain}, transform(more, m -> named_struct('start', m.start, 'kind', m.kind + 4, 'end', m.end))))")
    )
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {n})) as long)").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return d.select(
        "doc_id", *counts, F.sha2(F.expr(text % "first"), 256).alias("base_sha256"), F.expr(text % "all").alias("spans"),
        F.expr("cast(size(more) as long)").alias("n_more"),
    )
