"""Labels and values from model responses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import BORDER, NOBORDER, col, nullable_label, strip


def json_number(c, path: str) -> Column:
    """A number, or a string that holds one, at a JSON path; else null."""
    return F.get_json_object(col(c), path).try_cast("double")


def whole_json(c) -> Column:
    """Whether a text is one JSON value and nothing else (``get_json_object`` overlooks what follows)."""
    v = F.try_parse_json(F.concat(F.lit("["), col(c), F.lit("]")))
    return F.coalesce(F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(), F.lit(False))


def confidence(c) -> Column:
    return F.when(strip(c).startswith("{") & whole_json(c), json_number(c, "$.confidence"))


def reason(c) -> Column:
    return F.coalesce(F.when(whole_json(c), F.get_json_object(col(c), "$.reason")), F.lit(""))


def split_context(c) -> Column:
    """struct(left, target, right) around the first tagged sentence; without one, all is left."""
    pattern, x = r"(?s)^(.*?)<sentence>(.*?)</sentence>(.*)$", col(c)
    there = x.rlike(r"(?s)<sentence>.*?</sentence>")
    part = lambda k: strip(F.regexp_extract(x, pattern, k))
    return F.struct(
        F.when(there, part(1)).otherwise(x).alias("left"), F.when(there, part(2)).otherwise("").alias("target"), F.when(there, part(3)).otherwise("").alias("right")
    )


def render(template, values: list[tuple[str, Column]]) -> Column:
    """The template with its placeholders replaced in order; text put in is searched again by later ones."""
    x = col(template)
    for name, value in values:
        x = F.replace(x, F.lit("{" + name + "}"), value)
    return x


def lines(c) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(col(c), "\r?\n"), strip), lambda x: x != "")


# fixed values: phrases that mean a label
_PHRASES = (
    (r"\b(?:does\s+not|doesn't)\s+(?:start|mark|introduce)\b", NOBORDER),
    (r"\b(?:not\s+a|no)\s+new\s+segment\b", NOBORDER),
    (r"\b(?:starts?|marks?|introduces?)\s+(?:a\s+)?new\s+(?:event|scene|segment)\b", BORDER),
)


def label_token(c) -> Column:
    """The label in a noisy answer: a line of the first five that is one, else a whole word, else a phrase."""
    x = col(c)
    first = F.get(F.filter(F.transform(F.slice(lines(c), 1, 5), nullable_label), lambda v: v.isNotNull()), F.lit(0))
    low, up = F.lower(x), F.upper(x)
    tests = [(up.rlike(r"\bNOBORDER\b"), NOBORDER), (up.rlike(r"\bBORDER\b"), BORDER), *((low.rlike(p), label) for p, label in _PHRASES)]
    return F.coalesce(first, *[F.when(test, label) for test, label in tests])


def sentence_token(c) -> Column:
    """NONE or a number from an answer that names a sentence: the first of four lines, then of the whole text, that has either."""
    one = lambda v: F.when(v.rlike(r"(?i)\bNONE\b"), F.lit("NONE")).when(v.rlike(r"\b\d+\b"), F.regexp_extract(v, r"\b(\d+)\b", 1))
    tries = F.concat(F.slice(lines(c), 1, 4), F.array(strip(c)))
    return F.get(F.filter(F.transform(tries, one), lambda v: v.isNotNull()), F.lit(0))


def has_json(c) -> Column:
    return F.coalesce(col(c), F.lit("")).contains("{")


def json_closed(c) -> Column:
    """Whether the braces of a text are balanced again at some point after the first."""
    braces = F.filter(F.split(F.coalesce(col(c), F.lit("")), ""), lambda x: x.isin("{", "}"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"))

    def step(s, x):
        depth = s["depth"] + F.when(x == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (s["closed"] | ((x == "}") & (depth == 0))).alias("closed"))

    return F.aggregate(braces, start, step, lambda s: s["closed"]) & has_json(c)


def truncation_suspect(c) -> Column:
    """JSON that never closes, or prose without JSON."""
    return F.when(has_json(c), ~json_closed(c)).otherwise(strip(F.coalesce(col(c), F.lit(""))) != "")


def first_json_label(c) -> Column:
    """A label by ``json`` text alone: native form for responses whose JSON has no nested braces."""
    return nullable_label(F.get_json_object(F.regexp_extract(col(c), r"(?s)\{[^{}]*\}", 0), "$.label"))


# fixed values: what answers look like
_SURE = ((r"(?i)\b(?:Answer|Final\s*Answer)\s*:\s*BORDER\b", True), (r"(?i)\b(?:Answer|Final\s*Answer)\s*:\s*NOBORDER\b", False))
_LIST = (
    (r"(?i)\bAnswer\s*:\s*No\b", False),
    (r"(?i)\bAnswer\s*:\s*Yes\b", True),
    (r"(?i)\b(?:does\s+(?:\*{0,2})not(?:\*{0,2})|doesn't)\s+(?:start|introduce|mark\b)", False),
    (r"(?i)\b(?:starts?|introduces?|marks?)\s+(?:a\s+new\s+scene|the\s+beginning)", True),
)


def _ordered(x: Column, rules) -> Column:
    out = F.lit(None).cast("boolean")
    for pattern, value in reversed(rules):
        out = F.when(x.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def free_text_flag(c, list_mode: bool = True) -> Column:
    """Whether a free-text answer means a new scene; null if it says neither."""
    x = col(c)
    line = F.coalesce(F.get(F.split(strip(c), "\n"), F.lit(0)), F.lit(""))
    plain = F.lower(F.regexp_replace(line, r"(?U)[^\w]+", ""))
    return F.coalesce(
        F.when(plain.isin("border", "yes", "true"), True).when(plain.isin("noborder", "no", "false"), False),
        _ordered(x, _SURE),
        _ordered(x, _LIST) if list_mode else F.lit(None).cast("boolean"),
        F.when(line.contains("True"), True).when(line.contains("False"), False).when(strip(line).startswith("Yes"), True).when(strip(line).startswith("No"), False),
    )


def loose_flag(c) -> Column:
    """The last line's meaning, else the whole answer's."""
    rules = (*_SURE, (r"(?i)^(?:BORDER|Yes|True)$", True), (r"(?i)^(?:NOBORDER|No|False)$", False), *_LIST[2:])
    return F.coalesce(_ordered(F.element_at(F.concat(F.array(F.lit("")), lines(c)), -1), rules), _ordered(strip(c), rules))


def chunk_scores(c) -> Column:
    return F.from_json(col(c), "array<struct<sentence_id:int,score:double>>")


def chunk_score_flag(scores, local_id, threshold: float = 50.0, last: bool = False) -> Column:
    """Whether the local sentence's score reaches the threshold; the first (or last) entry of it counts; null if absent."""
    own = F.filter(col(scores), lambda x: x["sentence_id"] == col(local_id))
    score = F.get(own, F.size(own) - 1 if last else F.lit(0))["score"]
    return F.when(F.size(own) > 0, score >= threshold)


def verifier_keep(c) -> Column:
    """A verifier's decision: ``keep`` of the outermost JSON, else the one word of yes and no that the prose has."""
    x = col(c)
    said = F.lower(F.get_json_object(F.regexp_extract(x, r"(?s)\{.*\}", 0), "$.keep"))
    yes, no = F.lower(x).rlike(r"\b(?:yes|ja|true)\b"), F.lower(x).rlike(r"\b(?:no|nein|false)\b")
    return F.coalesce(F.when(said.isin("true", "yes", "ja"), True).when(said.isin("false", "no", "nein"), False), F.when(yes & ~no, True).when(no & ~yes, False))


def visible_text(parts) -> Column:
    """The text of the parts that aren't thoughts; of all parts if none is visible."""
    join = lambda xs: F.array_join(F.transform(xs, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    seen = join(F.filter(col(parts), lambda p: ~F.coalesce(p["thought"], F.lit(False))))
    return F.coalesce(F.nullif(seen, F.lit("")), join(col(parts)))


def usage_count(c, camel: str, snake: str) -> Column:
    """A token count under either spelling, 0 if there is none."""
    return F.coalesce(F.get_json_object(col(c), f"$.usageMetadata.{camel}").try_cast("int"), F.get_json_object(col(c), f"$.usage_metadata.{snake}").try_cast("int"), F.lit(0))


def prose_tail_label(c) -> Column:
    """A label that thinking aloud leaked at the end of a response."""
    tail = F.expr(f"right({c}, 500)") if isinstance(c, str) else F.right(c, F.lit(500))
    bare = F.replace(tail, F.lit(NOBORDER), F.lit(""))
    end = F.regexp_replace(tail, r"\s+$", "")
    return (
        F.when(tail.contains(NOBORDER) & ~bare.contains(BORDER), NOBORDER)
        .when(end.endswith(NOBORDER) | tail.contains("answer NOBORDER"), NOBORDER)
        .when(F.right(tail, F.lit(120)).contains(BORDER), BORDER)
    )


def feature_tags(c, known: list[str]) -> Column:
    """Known tags of a comma list in a JSON string field ``reason``, in order."""
    parts = F.transform(F.split(F.coalesce(F.get_json_object(col(c), "$.reason"), F.lit("")), ","), lambda x: F.lower(strip(x)))
    return F.filter(parts, lambda x: x.isin(*known))
