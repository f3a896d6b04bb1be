"""JSON documents: hits, their source, and aggregate results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import bind


# A string, a structural character or a scalar, with the blanks before it: together they are the text.
_TOKEN = r"""(?s)\s*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++)"""
_MEMBERS = "array<struct<name:string,value:string>>"
#: What the scanner of an object is at.
_KEY, _COLON, _VALUE, _AFTER = 0, 1, 2, 3


def raw_members(document: Column) -> Column:
    """Members of a JSON object as ``array<struct<name, value>>``, names and values spelled as in the text.

    Of members that repeat a name the last one counts. One pass over the tokens of the text keeps the depth and, at the
    depth of the object, where the value of each member begins and ends. Null for text that is not one JSON object.
    """
    empty = F.expr("CAST(array() AS array<struct<name:string,first:int,last:int>>)")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(_KEY).alias("phase"), F.lit("").alias("name"),
        F.lit(0).alias("first"), empty.alias("found"),
    )

    def step(state: Column, token: Column) -> Column:
        mark = F.right(token, F.lit(1))  # tells which kind of token it is
        member, at = state["depth"] == 1, state["at"]
        ends = member & (state["phase"] == _VALUE) & mark.isin(",", "}")
        one = F.struct(state["name"].alias("name"), state["first"].alias("first"), (at - 1).alias("last"))
        phase = (
            F.when((state["depth"] == 0) & (at > 0), F.lit(_AFTER)).when(~member, state["phase"]).when(state["phase"] == _KEY, F.lit(_COLON)).when(state["phase"] == _COLON, F.lit(_VALUE))
            .when(mark == ",", F.lit(_KEY)).otherwise(F.lit(_VALUE))
        )
        return F.struct(
            (at + 1).alias("at"),
            (state["depth"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            phase.alias("phase"),
            F.when(member & (state["phase"] == _KEY), F.ltrim(token)).otherwise(state["name"]).alias("name"),
            F.when(member & (state["phase"] == _COLON), at + 1).otherwise(state["first"]).alias("first"),
            F.when(ends, F.array_append(state["found"], one)).otherwise(state["found"]).alias("found"),
        )

    def cut(tokens: Column) -> Column:
        found = F.aggregate(tokens, start, step, lambda state: F.when(state["phase"] != _AFTER, state["found"]))
        last = lambda found: F.filter(
            found, lambda m, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda n: _name(n["name"]) == _name(m["name"]))
        )
        spelled = lambda m: F.regexp_replace(
            F.array_join(F.slice(tokens, m["first"] + 1, m["last"] - m["first"] + 1), ""), r"^\s+", ""
        )
        members = bind(found, last)
        return F.transform(members, lambda m: F.struct(_name(m["name"]).alias("name"), spelled(m).alias("value")))

    begins = F.json_object_keys(document).isNotNull()  # also if something follows the object
    return F.when(begins, bind(F.regexp_extract_all(document, F.lit(_TOKEN), F.lit(0)), cut))


def _name(spelled: Column) -> Column:
    """A member's name from its spelling, with its escapes resolved."""
    plain = F.substr(spelled, F.lit(2), F.length(spelled) - 2)
    return F.when(F.contains(spelled, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), spelled, F.lit("]")), "array<string>"), 0)).otherwise(plain)


def source_or_null(hit: Column) -> Column:
    """The ``_source`` member of a hit as its text, unchanged; null when absent or the hit is not a JSON object."""
    there = F.array_contains(F.json_object_keys(hit), "_source")
    return F.when(there, F.get(F.filter(raw_members(hit), lambda m: m["name"] == "_source"), 0)["value"])


def unwrap_source(hit: Column) -> Column:
    """The ``_source`` member; a hit without one fails the job."""
    return F.coalesce(
        source_or_null(hit), F.raise_error(F.concat(F.lit("hit without _source: "), F.coalesce(hit, F.lit("null"))))
    )


def unwrap_source_lenient(document: Column) -> Column:
    """The ``_source`` member where there is one, else the whole text as it is."""
    return F.coalesce(source_or_null(document), document)


def merge_agg_maps(hot: Column, cold: Column) -> Column:
    """Union of two name -> result maps; the hot value wins, a missing side gives the other one."""
    both = F.map_zip_with(hot, cold, lambda _, h, c: F.coalesce(h, c))
    return F.when(hot.isNull(), cold).when(cold.isNull(), hot).otherwise(both)


def merge_agg_json(hot: Column, cold: Column) -> Column:
    """``merge_agg_maps`` on JSON objects, whose members keep their spelling; when either side is not an object the hot text stands."""

    def joined(h: Column, c: Column) -> Column:
        more = F.filter(c, lambda m: ~F.exists(h, lambda k: k["name"] == m["name"]))
        parts = F.transform(F.concat(h, more), lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["value"]))
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    hot_members, cold_members = raw_members(hot), raw_members(cold)
    return (
        F.when(hot.isNull() | (hot == ""), cold)
        .when(cold.isNull() | (cold == ""), hot)
        .otherwise(bind(hot_members, lambda h: bind(cold_members, lambda c: F.when(h.isNull() | c.isNull(), hot).otherwise(joined(h, c)))))
    )


def _quoted(name: Column) -> Column:
    """A name as a JSON string."""
    listed = F.to_json(F.array(name))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)
