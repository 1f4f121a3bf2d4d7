"""Nested transcript lines as flat, linked tables.

A line is parsed once into a VARIANT. Nested `transform` calls walk the blocks and carry the
ancestor's path along, `flatten` joins what the levels give, and one `inline` per target table
emits rows. A projection unrolls `LEVELS` levels; blocks whose content goes deeper come back as
the roots of a next round, so no depth is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import checkpointed, conf

LEVELS = 3


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines + doc: the line as a VARIANT object; lines that are not one complete object are left out.

    The parser stops after the first value, so the line is parsed inside an array and once inside an
    object: text after the value, or a second value, breaks one of them. A repeated member counts
    with its last value.
    """
    with conf(lines.sparkSession, spark__sql__variant__allowDuplicateKeys="true"):
        parsed = lines.withColumn("_v", F.expr("try_parse_json(concat('[', raw, '\\n]'))")).withColumn(
            "_w", F.expr("try_parse_json(concat('{\"x\":', raw, '\\n}')) is not null")
        )
        parsed = parsed.where("_w and schema_of_variant(_v) like 'ARRAY<%'").withColumn("_a", F.expr("try_variant_get(_v, '$', 'array<variant>')"))
        parsed = parsed.where("size(_a) = 1").withColumn("doc", F.get("_a", F.lit(0))).where("schema_of_variant(doc) like 'OBJECT<%'")
        return parsed.drop("_v", "_w", "_a")


def _kind(v: str) -> str:
    """o(bject), a(rray), s(tring) or other, of a VARIANT expression."""
    return f"substr(schema_of_variant({v}), 1, 2)"


def _items(v: str, strings: bool) -> str:
    """The blocks of a content member as array<variant>."""
    kinds = "'OB', 'ST'" if strings else "'OB'"
    lone = f"when {_kind(v)} in ({kinds}) then array({v})"
    return f"(case when {v} is null then array() when {_kind(v)} = 'AR' then try_variant_get({v}, '$', 'array<variant>') {lone} else array() end)"


FIELDS = (
    "(case when {k} = 'ST' then 'text' else coalesce(try_variant_get({b}, '$.type', 'string'), '') end) as block_type, "
    "(case when {k} = 'ST' then '' else coalesce(try_variant_get({b}, '$.id', 'string'), '') end) as block_id, "
    "coalesce(try_variant_get({b}, '$.name', 'string'), '') as name, "
    "coalesce(try_variant_get({b}, '$.tool_use_id', 'string'), '') as tool_use_id, "
    "(case when {k} = 'ST' then try_variant_get({b}, '$', 'string') else try_variant_get({b}, '$.text', 'string') end) as text"
)


def _level(items: str, parent: str, depth: int, levels: int) -> str:
    """array<struct> of the blocks in `items` and, level by level, below them."""
    b, i = f"b{depth}", f"i{depth}"
    path = f"concat({parent}, cast({i} as string))" if parent else f"cast({i} as string)"
    kind, below = _kind(b), f"try_variant_get({b}, '$.content', 'variant')"
    own_content = f"(case when {kind} = 'OB' then {below} end)"
    deepest = depth + 1 >= levels
    rest = own_content if deepest else "cast(null as variant)"
    one = f"struct({path} as block_path, {FIELDS.format(b=b, k=kind)}, {rest} as rest)"
    row = f"array({one})"
    if not deepest:
        row = f"concat({row}, {_level(_items(own_content, False), f'concat({path}, {chr(39)}.{chr(39)})', depth + 1, levels)})"
    return f"flatten(transform({items}, ({b}, {i}) -> case when {kind} in ('OB', 'ST') then {row} else array() end))"


def blocks(parsed: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(record_id, block_path, parent_path, block_type, block_id, name, tool_use_id, text)."""
    content = "try_variant_get(doc, '$.message.content', 'variant')"
    frontier = parsed.selectExpr("record_id", "'' as at", f"{_items(content, True)} as items")
    parts: list[DataFrame] = []
    while True:
        rows = frontier.selectExpr("record_id", f"inline({_level('items', 'at', 0, levels)})")
        rows = rows.where("block_path is not null")
        deeper = rows.where("rest is not null").selectExpr("record_id", "concat(block_path, '.') as at", f"{_items('rest', False)} as items").where("size(items) > 0")
        parts.append(rows.drop("rest"))
        deeper = checkpointed(deeper)
        if deeper.isEmpty():
            break
        frontier = deeper
    cut = F.expr("case when instr(block_path, '.') > 0 then substring_index(block_path, '.', size(split(block_path, '[.]')) - 1) else '' end")
    return reduce(DataFrame.unionByName, parts).withColumn("parent_path", cut)


def records(parsed: DataFrame) -> DataFrame:
    """One row per line that is an object: its scalar members and the number of top blocks."""
    get = lambda p, t="string": f"try_variant_get(doc, '$.{p}', '{t}')"
    content = "try_variant_get(doc, '$.message.content', 'variant')"
    return parsed.selectExpr(
        "record_id", "file_name", "line_no",
        f"{get('type')} as record_type", f"{get('sessionId')} as session_id", f"{get('timestamp')} as ts",
        f"coalesce({get('isSidechain', 'boolean')}, false) as is_sidechain", f"coalesce({get('isMeta', 'boolean')}, false) as is_meta",
        f"{get('message.role')} as role",
        f"{get('message.usage.cache_read_input_tokens', 'bigint')} as cache_read", f"{get('message.usage.cache_creation_input_tokens', 'bigint')} as cache_creation",
        f"{get('message.usage.output_tokens', 'bigint')} as output_tokens",
        f"size(filter({_items(content, True)}, b -> {_kind('b')} in ('OB', 'ST'))) as n_blocks",
    )


def tool_calls(block_rows: DataFrame) -> DataFrame:
    """The tool_use blocks, with their parent block."""
    return block_rows.where("block_type = 'tool_use'").select("record_id", "block_path", "parent_path", F.col("block_id").alias("call_id"), "name")


def tool_results(block_rows: DataFrame) -> DataFrame:
    """The tool_result blocks, with their parent block and the call they answer."""
    return block_rows.where("block_type = 'tool_result'").select("record_id", "block_path", "parent_path", F.col("tool_use_id").alias("call_id"))
