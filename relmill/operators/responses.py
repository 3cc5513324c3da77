"""Model replies: cleaning, parsing, recovery of cut-off replies, and the extractor hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.functions.rows import keep_where, posexplode
from relmill.functions.text import let, null_if_empty, strip, text_of

RELATION_TYPE = "struct<head:string,relation:string,tail:string,evidence:string,skill:string>"
RELATION_LIST = f"array<{RELATION_TYPE}>"
TRIPLE = "struct<subject:string,relation:string,object:string>"
# ---- fixed values: reply syntax -----------------------------------------------------------
THINKING = r"(?s)<think>.*?</think>"
OPEN_FENCES = (r"\A```json", r"\A```")
CLOSE_FENCE = r"```\z"
LIST_KEY = '"relation_list"'
# -------------------------------------------------------------------------------------------
_PLAIN, _STRING = r'[^"\[\]{}]++', r'"(?:[^"\\]++|\\.)*+"'


def _closed(depth: int) -> tuple[str, str]:
    """Patterns of an object and of an array whose brackets all close, nested up to ``depth`` times."""
    inner = "|".join([_PLAIN, _STRING, *(_closed(depth - 1) if depth else ())])
    return rf"\{{(?:{inner})*+\}}", rf"\[(?:{inner})*+\]"


#: A closed object (deeper ones come in parts), an array without objects, strings (to the end if one breaks off) and what lies between, or a bracket.
TOKEN = rf"(?s){_closed(2)[0]}|\[(?:{_PLAIN}|{_STRING})*+\]|(?:{_PLAIN}|{_STRING}?)++|[\[\]{{}}]"


def complete_objects(list_text: Column) -> Column:
    """The outermost objects of a JSON list, as text, up to where the list ends or breaks off.

    One walk over the tokens with the open brackets as a stack, so objects may be nested to
    any depth. The walk ends where a bracket closes none of its kind; an object still open
    by then is left out. What is found grows as a string, "token count;" after another: an array
    would be copied element by element at each object.
    """
    start = F.struct(
        F.lit("").alias("open"), F.lit(1).alias("at"), F.lit(0).alias("first"), F.lit(False).alias("done"),
        F.lit("").alias("found"),
    )
    closes = F.create_map(F.lit("}"), F.lit("{"), F.lit("]"), F.lit("["))

    def step(acc: Column, token: Column) -> Column:
        opening = token.isin("{", "[")
        closing = token.isin("}", "]")
        entire = F.startswith(token, F.lit("{")) & (token != "{")
        top = F.substring(acc["open"], -1, 1)
        torn = closing & (top != closes[token])
        stack = (
            F.when(opening, F.concat(acc["open"], token))
            .when(closing, acc["open"].substr(F.lit(1), F.char_length(acc["open"]) - 1))
            .otherwise(acc["open"])
        )
        outer = ~F.contains(acc["open"], F.lit("{"))
        ends = (token == "}") & ~torn & ~F.contains(stack, F.lit("{"))
        size = acc["at"] - acc["first"] + 1
        place = lambda first, size: F.concat(acc["found"], first.cast("string"), F.lit(" "), size.cast("string"), F.lit(";"))
        last = closing | entire | (F.startswith(token, F.lit("[")) & (token != "["))
        moved = F.struct(
            stack.alias("open"),
            (acc["at"] + 1).alias("at"),
            F.when((token == "{") & outer, acc["at"]).otherwise(acc["first"]).alias("first"),
            (torn | (last & (stack == ""))).alias("done"),
            F.when(entire & outer, place(acc["at"], F.lit(1))).when(ends, place(acc["first"], size)).otherwise(acc["found"]).alias("found"),
        )
        return F.when(acc["done"], acc).otherwise(moved)

    def walk(tokens: Column) -> Column:
        found = F.filter(F.split(F.aggregate(tokens, start, step, lambda acc: acc["found"]), ";"), lambda o: o != "")

        def cut(o: Column) -> Column:
            first, size = (F.get(F.split(o, " "), F.lit(i)).cast("int") for i in (0, 1))
            return F.array_join(F.slice(tokens, first, size), "")

        return F.transform(found, cut)

    return let(F.regexp_extract_all(list_text, F.lit(TOKEN), 0), walk)


def clean_reply(raw: Column) -> Column:
    """Drop thinking traces and code fences."""
    body = strip(F.regexp_replace(text_of(raw), THINKING, ""))
    for fence in OPEN_FENCES:
        body = strip(F.regexp_replace(body, fence, ""))
    return strip(F.regexp_replace(body, CLOSE_FENCE, ""))


def reply_object(raw: Column) -> Column:
    """The JSON object of a reply: the whole reply, else its part from the first to the last brace; null if neither parses."""

    def pick(text: Column) -> Column:
        outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
        return F.when(F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull(), text).when(
            (outer != "") & F.try_parse_json(outer).isNotNull(), outer
        )

    return let(clean_reply(raw), pick)


def _items(list_of: Column) -> Column:
    """``STRUCT<relations, bad_items>`` of raw list elements: each object is parsed alone."""

    def sort(items: Column) -> Column:
        good = lambda x: F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull()
        return F.struct(
            F.transform(F.filter(items, good), lambda x: F.from_json(x, RELATION_TYPE)).alias("relations"),
            F.filter(items, lambda x: ~good(x)).alias("bad_items"),
        )

    return let(F.array_compact(F.coalesce(list_of, F.array().cast("array<string>"))), sort)


def _recovered(text: Column) -> Column:
    """The complete objects behind the list key; null when there are none."""
    at = F.locate(LIST_KEY, text)
    behind = F.when(at > 0, text.substr(at + F.lit(len(LIST_KEY)), F.char_length(text)))
    objects = complete_objects(null_if_empty(F.regexp_extract(behind, r"(?s)\[.*", 0)))
    return let(_items(objects), lambda r: F.when(F.size(r["relations"]) > 0, r))


def reply_struct(raw: Column) -> Column:
    """``STRUCT<relations, bad_items, parse_mode>``: full JSON, outermost object, recovery or reject.

    A list element that is no object, or one that does not parse, goes to ``bad_items`` and
    does not take the others with it.
    """

    def parse(text: Column) -> Column:
        outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)

        def decide(b: Column) -> Column:
            full, obj = b["t"], b["o"]
            ok_full = F.try_parse_json(full).isNotNull()
            ok_outer = (obj != "") & F.try_parse_json(obj).isNotNull()
            # text is what an element of type string holds, whatever the element is
            listed = lambda j: _items(F.from_json(j, "struct<relation_list:array<string>>")["relation_list"])
            rescued = F.coalesce(_recovered(obj), _recovered(full))
            return (
                F.when(ok_full, _result(listed(full), "full"))
                .when(ok_outer, _result(listed(obj), "outer"))
                .otherwise(
                    let(
                        rescued,
                        lambda r: F.when(r.isNotNull(), _result(r, "recovered")).otherwise(
                            _result(_items(F.array().cast("array<string>")), "rejected")
                        ),
                    )
                )
            )

        return let(F.struct(text.alias("t"), outer.alias("o")), decide)

    return let(clean_reply(raw), parse)


def _result(items: Column, mode: str) -> Column:
    return F.struct(items["relations"].alias("relations"), items["bad_items"].alias("bad_items"), F.lit(mode).alias("parse_mode"))


def parse_responses(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``relations ARRAY<STRUCT>``, ``bad_items ARRAY<STRING>`` and ``parse_mode`` to every reply row."""
    parsed = df.withColumn("_p", reply_struct(F.col(reply)))
    return (
        parsed.withColumn("relations", F.col("_p.relations"))
        .withColumn("bad_items", F.col("_p.bad_items"))
        .withColumn("parse_mode", F.col("_p.parse_mode"))
        .drop("_p")
    )


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rejected = F.col("parse_mode") == "rejected"
    return keep_where(parsed, ~rejected), keep_where(parsed, rejected)


def parse_triples(
    df: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Subject/relation/object rows of a bare array, a ``relations`` object, or the first
    bracketed part of the text."""

    def triples(text: Column) -> Column:
        valid = F.try_parse_json(text).isNotNull()
        head = F.substring(strip(text), 1, 1)
        bare = F.when(valid & (head == "["), F.from_json(text, "array<string>"))
        named = F.when(
            valid & (head == "{"),
            F.from_json(text, "struct<relations:array<string>>")["relations"],
        )
        inner = null_if_empty(F.regexp_extract(text, r"(?s)\[.*\]", 0))
        found = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, "array<string>"))
        # elements that are no objects are skipped, each on its own
        objects = F.filter(F.coalesce(bare, named, found), lambda x: F.startswith(x, F.lit("{")))
        parsed = F.transform(objects, lambda x: F.from_json(x, TRIPLE))
        return F.coalesce(parsed, F.array().cast(f"array<{TRIPLE}>"))

    rows = df.select(
        *keep, posexplode(let(text_of(F.col(raw)), triples)).alias("triple_ord", "t")
    )
    return rows.select(*keep, "triple_ord", "t.*")


def with_extractor(
    prompts: DataFrame,
    extract: Callable[[str], str],
    prompt: str = "prompt",
    key: str = "prompt_id",
) -> DataFrame:
    """Plug-in point: run a user function over the prompts, batch-wise inside the tasks.

    Blank prompts are answered with an empty reply without calling the function.
    """
    import pandas as pd

    schema = f"{key} {prompts.schema[key].dataType.simpleString()}, reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [
                extract(p) if isinstance(p, str) and p.strip() else '{"relation_list": []}'
                for p in batch[prompt]
            ]
            yield pd.DataFrame({key: batch[key], "reply": replies})

    return prompts.select(key, prompt).mapInPandas(run, schema)
