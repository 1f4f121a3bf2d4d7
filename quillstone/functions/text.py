"""Text expressions: identities, chunks, tokens, titles, paths. All are Columns; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and patterns that results depend on.
CHUNK = 800
TITLE_MAX = 512
UNTITLED = "(untitled)"
TOKEN = "[a-z0-9]+(?:[._-][a-z0-9]+)+|[a-z0-9]+"
TITLE_TOKEN = "[a-z0-9][a-z0-9._-]*"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PATH_EXTENSIONS = ("md", "sh", "py", "js", "ts", "json", "toml", "yaml", "yml", "bats", "jsonl")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def framed(*parts) -> Column:
    """Each part behind its length in code points, so that no shift of a boundary goes unseen."""
    return F.concat(*[y for p in parts for y in (F.length(_c(p)).cast("string"), F.lit(":"), _c(p))])


def content_hash(*parts) -> Column:
    return F.substring(F.sha2(framed(*parts), 256), 1, 24)


def drawer_id(wing, room, text) -> Column:
    return F.concat(F.lit("drawer_"), _c(wing), F.lit("_"), _c(room), F.lit("_"), content_hash(wing, room, text))


def tunnel_id(wing_a, room_a, wing_b, room_b) -> Column:
    ends = F.sort_array(F.array(F.concat(_c(wing_a), F.lit("/"), _c(room_a)), F.concat(_c(wing_b), F.lit("/"), _c(room_b))))
    return F.substring(F.sha2(F.array_join(ends, "|"), 256), 1, 16)


def chunks(text, size: int = CHUNK) -> Column:
    """array<struct<chunk_index, text>> of slices; empty unless the text is longer than one."""
    t = _c(text)
    n = F.ceil(F.length(t) / F.lit(size)).cast("int")
    cut = lambda i: F.struct(i.alias("chunk_index"), F.substr(t, i * size + 1, F.lit(size)).alias("text"))
    return F.when(F.length(t) > size, F.transform(F.sequence(F.lit(0), n - 1), cut)).otherwise(F.array().cast("array<struct<chunk_index:int,text:string>>"))


def chunk_id(parent, index) -> Column:
    return F.format_string("%s_chunk_%06d", _c(parent), _c(index))


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def expand(token: Column) -> Column:
    """A compound identifier, its parts and its growing prefixes, each once; a plain token alone."""
    parts = F.split(token, "[._-]")
    prefix = lambda i: F.call_function("regexp_extract", token, F.concat(F.lit("^((?:[a-z0-9]+[._-]){"), (i - 1).cast("string"), F.lit("}[a-z0-9]+)")), F.lit(1))
    grown = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), prefix)
    return F.when(token.rlike("[._-]"), F.array_distinct(F.concat(F.array(token), parts, grown))).otherwise(F.array(token))


def index_tokens(text) -> Column:
    return F.flatten(F.transform(tokens(text), expand))


def strip(x) -> Column:
    """x without Unicode blanks at either end."""
    return F.regexp_replace(_c(x), f"^{BLANKS}|{BLANKS}$", "")


def derive_title(text) -> Column:
    """The first line that is not blank, at most 512 characters, else '(untitled)'."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), LINE_END), strip), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, TITLE_MAX), F.lit(UNTITLED))


def title_tokens(title) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(title), F.lit(""))), F.lit(TITLE_TOKEN), F.lit(0)))


def leading_id(title) -> Column:
    """The first word of a title, past hashes and blanks, if it has the shape of an issue id, else null."""
    first = F.lower(F.regexp_extract(F.coalesce(_c(title), F.lit("")), r"^[# ]*\s*(\S+)", 1))
    return F.when(first.rlike(r"^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$"), first)


def normalized(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", " "))


def word_set(x, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9 ]", " "), " +"), lambda t: F.length(t) >= least))


def jaccard(a, b, empty: float) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def id_prefix(x) -> Column:
    """What stands before the last hyphen, if at least three letters or digits follow it; dotted tail ignored."""
    stripped = F.regexp_extract(_c(x), r"^([^.]*)", 1)
    return F.nullif(F.regexp_extract(stripped, r"^(.+)-[a-z0-9]{3,}$", 1), F.lit(""))


def id_scan(x, prefix: str) -> Column:
    """Ids with a literal prefix that start a token, in order of first appearance."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in prefix)
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(rf"(?:^|[^A-Za-z0-9._/-])({literal}-[a-z0-9]{{3,}}(?:\.[a-z0-9]+)*)"), F.lit(1)))


def any_id_scan(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"(?:^|[^A-Za-z0-9._/-])([a-z][a-z0-9_]*-[0-9a-f]{3}(?:\.[0-9]+)*)"), F.lit(1)))


def norm_path(x) -> Column:
    """A listed path without annotations, outer blanks, 'optional ' and a closing slash."""
    bare = F.trim(F.regexp_replace(_c(x), r"[(\[].*$", ""))
    return F.regexp_replace(F.regexp_replace(bare, "^optional ", ""), "/$", "")


def is_path(x) -> Column:
    p = _c(x)
    return (p != "") & ~p.rlike(r"\s") & ~p.startswith("(") & (p.contains("/") | p.rlike(r"^\..") | p.rlike(r"^.+\.[^.]+$"))


def extract_paths(x) -> Column:
    """Sorted distinct file paths with a known extension."""
    ends = "|".join(sorted(PATH_EXTENSIONS, key=len, reverse=True))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(rf"(?<![A-Za-z0-9_./-])[A-Za-z0-9_./-]+\.(?:{ends})\b"), F.lit(0))))


def cluster_key(files) -> Column:
    """The first decision-shaped word in a comma-joined file list, else the top folder of its first file."""
    low = F.lower(F.coalesce(_c(files), F.lit("")))
    first = F.regexp_extract(F.coalesce(_c(files), F.lit("")), r"^,*([^,]+)", 1)
    key = F.when(low.contains("schema"), "schema")
    for word in ("migrat", "proto", "interface", "config"):
        key = key.when(low.contains(word), word)
    return key.when(first.contains("/"), F.substring_index(first, "/", 1)).when(first == "", "_misc").otherwise("_root")


def truncate_entry(x, most: int = 200) -> Column:
    body = F.regexp_replace(_c(x), r"\s+$", "")
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body)


def strip_fences(x) -> Column:
    """x without its code-fence lines."""
    return F.array_join(F.filter(F.split(_c(x), "\n"), lambda line: ~line.rlike("^```")), "\n")


def pull_url(x) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"https://github\.com/[^/\s]+/[^/\s]+/pull/[0-9]+", 0), F.lit(""))


def repo_slugs(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"github\.com[:/]([A-Za-z0-9_.-]+/[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*?)(?:\.git)?(?:[^A-Za-z0-9_.-]|$)"), F.lit(1)))


def wing_slug(x) -> Column:
    """One key for spellings of a wing: case, hyphens and a plural s folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "-", "_"), "s$", "")


def age_bucket(then, now) -> Column:
    s = F.unix_timestamp(_c(now).cast("timestamp")) - F.unix_timestamp(_c(then).cast("timestamp"))
    whole = lambda d: F.floor(s / d).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h")))
        .otherwise(F.concat(whole(86400), F.lit("d")))
    )


def iso(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss")


def exploded_chunks(drawers: DataFrame) -> DataFrame:
    """(parent_id, id, chunk_index, text) of all texts over one chunk."""
    return drawers.select(F.col("id").alias("parent_id"), F.explode(chunks("text")).alias("c")).select("parent_id", chunk_id("parent_id", F.col("c.chunk_index")).alias("id"), "c.chunk_index", "c.text")
