"""One long table of claims: what sources say of candidates, a row per fact, in a form that merges.

A claim is a row of (candidate_key, kind, a, b, alone, sub) and of cells whose merging is a sum, a least or a greatest value. ``combine`` merges
the rows of equal names; what it returns has the same columns and may be merged again with more, in any grouping and any order. So rows are
combined before they move, a candidate with very many rows does not have to fit one task, and combined claims are all that has to be kept
of profiles that come in batches.

=============  ==========================  =================================================================
kind           a, b, alone, sub            cells
=============  ==========================  =================================================================
a field        -                           best: the claim of the highest confidence, of equals the earliest source's
profile        -                           n: profiles; used: those that hold anything; top: 1 if one has links
skill          name, sub: source           first: place and confidence of the first claim
other          link                        first: its first place
experience     company, title, or alone    first: the first entry's names; long1 to long3: longest start, end, summary
education      institution, degree         first; long1: longest field; top: last year
=============  ==========================  =================================================================
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.text import let, strip_ws, truthy
from fusewright.schema import LOCATION
from fusewright.sources.profile import has_any_field

FIELDS = ("full_name", "headline", "years_experience", "location", "emails", "phones")
SITES = ("linkedin", "github", "portfolio")
LISTS = ("skill", "experience", "education", "other")
KINDS = (*FIELDS, *SITES, *LISTS, "profile")
NAMES = ("candidate_key", "kind", "a", "b", "alone", "sub")

LONGEST = "struct<n:int,o:int,p:int,v:string>"
CELLS = {
    "n": "bigint",
    "used": "bigint",
    "top": "int",
    "first": "struct<ord:int,pos:int,h:bigint,c:double,x:string,y:string>",
    "long1": LONGEST,
    "long2": LONGEST,
    "long3": LONGEST,
    "best": f"struct<c:double,o:int,h:bigint,text:string,number:double,at:{LOCATION},list:array<string>,source:string>",
}
SCHEMA = "candidate_key string, kind string, a string, b string, alone string, sub string, " + ", ".join(f"{k} {v}" for k, v in CELLS.items())


def _claim(kind: str, a: Column | None = None, b: Column | None = None, alone: Column | None = None, sub: Column | None = None, **cells: Column) -> Column:
    names = {"a": a, "b": b, "alone": alone, "sub": sub}
    text = [(F.lit(None) if c is None else c).cast("string").alias(k) for k, c in names.items()]
    return F.struct(F.lit(kind).alias("kind"), *text, *[(cells[k] if k in cells else F.lit(None)).cast(t).alias(k) for k, t in CELLS.items()])


def _best(kind: str, claim: Column, order: Column, there: Column, **value: Column) -> Column:
    # the hash makes equal claims of one source come out alike on every run
    cells = {"text": F.lit(None), "number": F.lit(None), "at": F.lit(None), "list": F.lit(None)} | value
    best = F.struct(claim["confidence"].alias("c"), (-order).alias("o"), F.xxhash64(F.to_json(claim)).alias("h"), *[v.alias(k) for k, v in cells.items()], claim["source"].alias("source"))
    return F.when(claim.isNotNull() & there, _claim(kind, best=best))


def _longest(value: Column, order: Column, pos: Column) -> Column:
    """The longest of the values, the first of equals; null and empty ones do not count."""
    given = truthy(value)
    return F.when(given.isNotNull(), F.struct(F.length(given).alias("n"), (-order).alias("o"), (-pos).alias("p"), given.alias("v")))


def _entry_claim(kind: str, entry: Column, names: tuple[str, str], order: Column, pos: Column, hashed: Column, **cells: Column) -> Column:
    """A claim with the key by which duplicates meet, worked out once; an entry without both of its parts is alone."""

    def of(key: Column) -> Column:
        both = key["a"].isNotNull() & key["b"].isNotNull()
        alone = F.concat_ws(":", order.cast("string"), pos.cast("string"), hashed.cast("string"))
        first = F.struct(order.alias("ord"), pos.alias("pos"), hashed.alias("h"), F.lit(None).cast("double").alias("c"), entry[names[0]].alias("x"), entry[names[1]].alias("y"))
        return _claim(kind, F.when(both, key["a"]), F.when(both, key["b"]), F.when(~both, alone), first=first, **cells)

    return let(F.struct(*[F.lower(strip_ws(truthy(entry[name]))).alias(k) for k, name in zip("ab", names)]), of)


def claims(profiles: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """The claims of source profiles (``SCHEMA``), read once; with ``kinds`` only some of them."""
    order, yes = F.col("source_ord"), F.lit(True)
    of: dict[str, Column] = {}
    value = {"full_name": "text", "headline": "text", "years_experience": "number", "location": "at", "emails": "list", "phones": "list"}
    for k, cell in value.items():
        claim = F.col(k)
        of[k] = F.array(_best(k, claim, order, F.size(claim["value"]) > 0 if cell == "list" else yes, **{cell: claim["value"]}))
    for k in SITES:
        link = truthy(F.col("links.value")[k])
        claim = F.when(link.isNotNull(), F.struct(link.alias("value"), F.col("links.confidence").alias("confidence"), F.col("links.source").alias("source")))
        of[k] = F.array(_best(k, claim, order, yes, text=link))
    place = lambda pos, **more: F.struct(order.alias("ord"), pos.alias("pos"), F.lit(None).cast("long").alias("h"), more.get("c", F.lit(None)).cast("double").alias("c"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
    of["skill"] = F.transform("skills", lambda s, i: _claim("skill", a=s["name"], sub=s["source"], first=place(i, c=s["confidence"])))
    of["other"] = F.transform("links.value.other", lambda x, i: _claim("other", a=x, first=place(i)))
    hashed = lambda e: F.xxhash64(F.col("source"), F.to_json(e))
    long = lambda e, i, names: {f"long{k}": _longest(e[n], order, i) for k, n in enumerate(names, 1)}
    of["experience"] = F.transform("experience", lambda e, i: _entry_claim("experience", e, ("company", "title"), order, i, hashed(e), **long(e, i, ("start", "end", "summary"))))
    of["education"] = F.transform("education", lambda e, i: _entry_claim("education", e, ("institution", "degree"), order, i, hashed(e), **long(e, i, ("field",)), top=e["end_year"]))
    holds = has_any_field()
    of["profile"] = F.array(_claim("profile", n=F.lit(1), used=holds.cast("int"), top=F.col("links").isNotNull().cast("int")))
    empty = F.array().cast(f"array<struct<kind:string,a:string,b:string,alone:string,sub:string,{','.join(f'{k}:{v}' for k, v in CELLS.items())}>>")
    every = F.concat(*[F.coalesce(of[k], empty) for k in kinds])
    rows = profiles.select("candidate_key", F.explode(every).alias("c")).where(F.col("c").isNotNull())
    return rows.select("candidate_key", *[F.col(f"c.{k}").alias(k) for k in (*NAMES[1:], *CELLS)])


def combine(rows: DataFrame, names: Iterable[str] = NAMES) -> DataFrame:
    """One row for each name of ``claims``, or of claims that were combined before; rows are merged before the one exchange."""
    merged = {"n": F.sum, "used": F.sum, "top": F.max, "first": F.min} | dict.fromkeys(("long1", "long2", "long3", "best"), F.max)
    return rows.groupBy(*names).agg(*[merged[k](k).alias(k) for k in CELLS])
