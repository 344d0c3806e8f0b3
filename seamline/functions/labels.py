"""Labels, texts, keys and small scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER, NOBORDER = "BORDER", "NOBORDER"
# fixed values: spellings of the labels
_YES, _NO = ("BORDER", "TRUE", "YES"), ("NOBORDER", "NO_BORDER", "FALSE", "NO")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: the characters of white space
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.btrim(col(c), F.lit(SPACES))


def nullable_label(c) -> Column:
    """The label that a value names, else null."""
    x = F.upper(strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")))
    return F.when(x.isin(*_YES), BORDER).when(x.isin(*_NO), NOBORDER)


def total_label(c) -> Column:
    """The label that a value names; ``1`` names a border, anything else (null too) none."""
    x = F.upper(strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")))
    return F.when(x.isin(*_YES, "1"), BORDER).otherwise(NOBORDER)


def gold_label(c) -> Column:
    return F.when(F.upper(strip(c)) == BORDER, BORDER).otherwise(NOBORDER)


def as_label(flag) -> Column:
    return F.when(col(flag), BORDER).otherwise(NOBORDER)


def collapse_space(c, lower: bool = False) -> Column:
    x = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.lower(x) if lower else x


def clean_text(c) -> Column:
    """Stripped; null and ``nan`` are empty."""
    x = F.coalesce(strip(c), F.lit(""))
    return F.when(F.lower(x) == "nan", "").otherwise(x)


def int_or(c, fallback) -> Column:
    """The whole part of a number in a string, else ``fallback``."""
    return F.coalesce(col(c).try_cast("double"), col(fallback)).cast("int")


def slug(c) -> Column:
    """Lower case; each run of other characters than letters and digits is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def ascii_slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def shell_quoted(c) -> Column:
    """A word of a command line, quoted if a shell would read it otherwise."""
    x = col(c)
    return F.when(x.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def command_line(words) -> Column:
    """An array of words as one command line."""
    return F.array_join(F.transform(col(words), shell_quoted), " ")


def config_text(**values) -> Column:
    """Settings as JSON: sorted by name, one a line, nulls spelled out."""
    lines = []
    for name in sorted(values):
        text = F.to_json(F.array(col(values[name])), {"ignoreNullFields": "false"})
        lines.append(F.concat(F.lit(f'  "{name}": '), F.substring(text, F.lit(2), F.length(text) - 2)))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


# fixed values: tokens of an answer by its format
NEW_TOKENS = {"cot_list": 256, "no_cot": 128, "json": 96}
OTHER_NEW_TOKENS = 96


def new_tokens(kind) -> Column:
    """How many tokens an answer of a format may have."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NEW_TOKENS.items() for x in pair]), col(kind)), F.lit(OTHER_NEW_TOKENS))


def run_folder(root, area, day, run=None) -> Column:
    """Where a run's outputs lie: runs by area and day, reproductions apart from them."""
    above = F.when(col(area) == "reproduction", F.lit("outputs")).otherwise("outputs/runs")
    return F.concat_ws("/", root, above, col(area), col(day), *([] if run is None else [run]))


def schema_file(family, schemas: dict[str, str | None]) -> Column:
    """The schema file of a family of prompts, null for one whose answers are plain text; an unknown family is an error."""
    known = F.create_map(*[x for name, file in schemas.items() for x in (F.lit(name), F.lit(file).cast("string"))])
    return F.when(F.map_contains_key(known, col(family)), F.try_element_at(known, col(family))).otherwise(F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce(col(family), F.lit("null")))).cast("string"))


def model_path(c) -> Column:
    return F.translate(col(c), "/:", "__")


def short_model(c) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def stem_number(c) -> Column:
    """The first number in a name, else null."""
    return F.expr("nullif(regexp_extract({0}, '([0-9]+)', 1), '')".format(c)).try_cast("long")


def eval_status(pred, gold) -> Column:
    """TP, FP, FN or TN of two flags."""
    p, g = col(pred), col(gold)
    return F.when(p & g, "TP").when(p, "FP").when(g, "FN").otherwise("TN")


def preview(c, n: int) -> Column:
    """The first ``n`` characters, line ends as spaces."""
    return F.substring(F.regexp_replace(col(c), "[\r\n]", " "), 1, n)


def strip_controls(c) -> Column:
    return F.regexp_replace(col(c), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def first_line(c, n: int = 240) -> Column:
    """The first line that isn't blank, stripped, at most ``n`` characters; empty if there is none."""
    lines = F.filter(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: strip(x) != "")
    return F.coalesce(F.substring(strip(F.get(lines, F.lit(0))), 1, n), F.lit(""))


def html_text(c) -> Column:
    """Readable text of markup: scripts and styles go, block ends are line ends, a few references are decoded."""
    x = F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(p|div|h[1-6]|li|tr|section|article)\s*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), " ?\n ?", "\n")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def fp_tag(distance, confidence) -> Column:
    """How far a false positive is from gold, or how sure it was."""
    d = col(distance)
    return F.when(d <= 1, "off_by_one").when(d <= 3, "near_miss").when(col(confidence) >= 0.85, "confident_fp").otherwise("isolated_fp")


def segment_type(c) -> Column:
    x = F.lower(col(c))
    return F.when(x.contains("nicht") | x.contains("nonscene"), "Nonscene").otherwise("Scene")


def sequence_length(budget) -> Column:
    return F.least(F.lit(4096), col(budget) + 768)


def config_hash(*cols: str) -> Column:
    """Sixteen hex digits that name a configuration; fields in alphabetical order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))), 256), 1, 16)


def cost(prompt, output, thought, in_rate: float, out_rate: float) -> Column:
    """Cost of a request in currency; thoughts are billed as output, missing counts are 0; rates are per million."""
    p, o, t = (F.coalesce(col(c), F.lit(0)) for c in (prompt, output, thought))
    return (p * in_rate + (o + t) * out_rate) / 1_000_000


def alerts(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def contains_word(c: Column, words: list[str]) -> Column:
    """Whether any word stands in the text (phrases with a space: anywhere in it)."""
    single = [w for w in words if " " not in w]
    x = c.rlike(r"(?U)\b(?:" + "|".join(single) + r")\b") if single else F.lit(False)
    for w in words:
        if " " in w:
            x = x | c.contains(w)
    return x


# fixed values: cue words by category
CUES = {
    "time": ["time", "earlier", "later", "next day", "next morning", "afterward", "afterwards", "meanwhile", "subsequent", "zeit", "spaeter", "später", "danach", "morgens", "abends", "nachts", "tagsspaeter", "tags spaeter", "tags später", "naechsten tag", "nächsten tag"],
    "location": ["location", "place", "scene shifts", "scene moves", "moved to", "elsewhere", "outside", "inside", "ort", "raum", "bewegt sich nach", "geht zu", "draussen", "draußen", "drinnen"],
    "character": ["character", "new character", "introduces", "joined by", "figuren", "figur", "neue figur", "tritt auf", "kommt herein"],
    "action": ["action", "new event", "begins to", "starts to", "handlung", "neues ereignis", "beginnt zu", "faengt an", "fängt an"],
}


def shift_cues(c) -> Column:
    """Categories of cues in the text, in fixed order."""
    x = F.lower(F.coalesce(col(c), F.lit("")))
    return alerts(*[(contains_word(x, words), name) for name, words in CUES.items()])


def error_kind(c) -> Column:
    """Kind of a provider's error; the first test that holds decides."""
    x, low = col(c), F.lower(col(c))
    return (
        F.when(x.contains("401") | x.contains("403") | low.contains("invalid api key") | low.contains("unauthorized"), "auth_error")
        .when(x.contains("402") | (low.contains("insufficient") & low.contains("credit")) | low.contains("payment required"), "billing_error")
        .when((x.contains("404") | low.contains("not found")) & (low.contains("model") | low.contains("model_name")), "model_not_found")
        .when(x.contains("429") | low.contains("rate limit") | low.contains("rate-limit") | low.contains("rate limited"), "rate_limit")
        .otherwise("api_error")
    )


# fixed values: where errors say how long to wait
RETRY_PATTERNS = (r'(?i)"retry_after_seconds(?:_raw)?"\s*:\s*([\d.]+)', r"(?i)Retry-After['\"]?\s*[:=]\s*['\"]?(\d+)")


def retry_after(c, attempt) -> Column:
    """Seconds to wait: what the error says (1 at least), else doubling from 5 up to 60."""
    said = [F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")).try_cast("double") for p in RETRY_PATTERNS]
    said = [F.when(s.isNotNull(), F.greatest(F.lit(1.0), s)) for s in said]
    return F.coalesce(*said, F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), F.least(col(attempt), F.lit(6)))))
