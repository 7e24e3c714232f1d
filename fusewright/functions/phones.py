"""Phone numbers by a numbering plan: validity, E.164 form, and numbers in free text.

The plan is a table of calling codes with the lengths and first digits of their national numbers, looked up in one map. Codes that are
assigned but not in the table may have numbers of any first digit. It is coarser than the carriers' own ranges: a number of a
right length and first digit passes even where no operator has it.
"""
from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusewright.functions.text import extract_phones, let

#: Fixed values (ITU-T E.164): calling code, shortest and longest national number, its possible first digits.
PLAN = """
1 10 10 23456789
7 10 10 34789
20 8 10 123456789
27 9 9 12345678
30 10 10 26789
31 9 9 12345678
32 8 9 123456789
33 9 9 123456789
34 9 9 56789
36 8 9 123456789
39 6 11 0123456789
40 9 9 2346789
41 9 9 23456789
43 5 13 123456789
44 9 10 1235789
45 8 8 23456789
46 7 10 123456789
47 8 8 23456789
48 9 9 123456789
49 6 12 123456789
51 8 9 123456789
52 10 10 123456789
53 6 8 234567
54 10 11 12369
55 10 11 123456789
56 9 9 23456789
57 10 10 136
58 10 10 24589
60 8 10 1345678
61 9 9 123478
62 8 12 2345678
63 8 10 23456789
64 8 10 234679
65 8 8 3689
66 8 9 2345678
81 9 10 123456789
82 8 10 123456789
84 9 10 123456789
86 10 11 123456789
90 10 10 234589
91 10 10 123456789
92 9 10 23456789
93 9 9 234567
94 9 9 1234567
95 7 10 123456789
98 10 10 123456789
212 9 9 5678
213 8 9 123456789
216 8 8 234579
233 9 9 2345
234 8 10 123456789
254 9 9 124567
255 9 9 2678
256 9 9 2347
351 9 9 236789
352 5 11 23456789
353 7 9 123456789
354 7 9 345678
358 6 12 123456789
359 7 9 23456789
370 8 8 345678
371 8 8 23678
372 7 8 345678
380 9 9 345679
381 8 10 12367
385 8 9 1234567
386 8 8 1234567
420 9 9 234567
421 9 9 23459
852 8 8 2356789
853 8 8 268
855 8 9 123456789
880 8 10 123456789
886 8 9 23456789
960 7 7 3679
961 7 8 1345789
962 8 9 23567
963 8 9 1234589
964 8 10 1234567
965 8 8 12569
966 9 9 1589
967 7 9 1234567
968 8 8 279
971 8 9 23456789
972 8 9 2345789
973 8 8 13679
974 8 8 34567
975 7 8 12345678
976 8 8 1256789
977 8 10 123456789
992 9 9 34579
993 8 8 1235678
994 9 9 1245679
995 9 9 34579
996 9 9 2345679
998 9 9 567789
"""
#: Assigned calling codes, by zone.
CALLING_CODE = (
    r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-3689]|2[2-6]\d|29[0179]|35\d|37\d|38[0-35-79]|42[013]|"
    r"50\d|59\d|6[78]\d|69[0-2]|85[02356]|88[0-8]|96\d|97[0-79]|99[2-68]"
)
#: Of codes that are not in the table.
OTHERS = (5, 12, "0123456789")
#: Zone 1: neither area nor exchange begins with 0 or 1 or is a service code, and area 555 is not assigned.
ZONE_1 = r"^(?!.11|555)[2-9]\d\d(?!.11)[2-9]\d{6}$"
HOME = "91"
#: A run that may be a number: what stands before it, the run, and a letter or digit right after it, with which it is none.
CANDIDATE = r"(^|[^0-9A-Za-z+])(\+?\(?\d[\d ().\-]{5,20}\d)([0-9A-Za-z]?)"


def _plan() -> Column:
    rows = {code: {"least": int(a), "most": int(b), "leads": leads} for code, a, b, leads in map(str.split, PLAN.strip().splitlines())}
    return F.from_json(F.lit(json.dumps(rows)), "map<string,struct<least:int,most:int,leads:string>>")


def _valid(code: Column, national: Column) -> Column:
    least, most, leads = OTHERS
    other = F.struct(F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(leads).alias("leads"))

    def fits(row: Column) -> Column:
        shape = F.length(national).between(row["least"], row["most"]) & F.contains(row["leads"], F.substring(national, 1, 1))
        return shape & ((code != "1") | national.rlike(ZONE_1))

    return let(F.coalesce(_plan()[code], other), fits)


def _international(digits: Column) -> Column:
    """``+`` and the digits after a plus, without the trunk zero that some put after the code; null if they are no number."""

    def of(code: Column) -> Column:
        rest = F.substr(digits, F.length(code) + 1)
        national = F.when(rest.startswith("0") & (code != "39"), F.substr(rest, F.lit(2))).otherwise(rest)
        return F.when((code != "") & _valid(code, national), F.concat(F.lit("+"), code, national))

    return let(F.regexp_extract(digits, rf"^(?:{CALLING_CODE})", 0), of)


def _national(digits: Column) -> Column:
    """A number without a plus: one of the home country, with or without its trunk zero or its code."""
    home = F.lit(HOME)
    local = F.when(digits.startswith("0"), F.substr(digits, F.lit(2))).otherwise(digits)
    coded = F.substr(digits, F.lit(len(HOME) + 1))
    return F.when(_valid(home, local), F.concat(F.lit("+" + HOME), local)).when(digits.startswith(HOME) & _valid(home, coded), F.concat(F.lit("+"), digits))


def e164(c: Column) -> Column:
    """The number in E.164 form; null if the plan has no such number. ``00`` is a plus; without either it is one of the home country."""
    of = lambda kept: F.when(kept.rlike(r"^\+\d+$"), _international(F.substr(kept, F.lit(2)))).when(kept.rlike(r"^00\d+$"), _international(F.substr(kept, F.lit(3)))).when(kept.rlike(r"^\d+$"), _national(kept))
    return let(F.regexp_replace(c, r"[^\d+]", ""), of)


def normalize_phone(c: Column) -> Column:
    """E.164 by the plan; a number that the plan does not have gets the home code where its length allows it, else it is unchanged."""
    kept = F.regexp_replace(c, r"[^\d+]", "")
    ten = lambda k: F.when(k.startswith(HOME) & (F.length(k) == 12), F.concat(F.lit("+"), k)).when(F.length(k) == 10, F.concat(F.lit("+" + HOME), k)).otherwise(c)
    return F.coalesce(e164(c), let(kept, ten))


def matched_phones(text: Column) -> Column:
    """Numbers of the plan in a text, in E.164 form, distinct, in order. A run of two numbers with a space between is both."""
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(2))
    after = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(3))
    free = F.filter(F.transform(runs, lambda x, i: F.when(F.get(after, i) == "", x)), lambda x: x.isNotNull())
    each = lambda x: let(e164(x), lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(F.transform(F.split(x, " +"), lambda part: e164(part))))
    return F.array_distinct(F.filter(F.flatten(F.transform(free, each)), lambda v: v.isNotNull()))


def find_phones(text: Column) -> Column:
    """Numbers of the plan in E.164 form; where a text has none, runs of 10 to 15 digits as they stand."""
    return let(matched_phones(text), lambda found: F.when(F.size(found) > 0, found).otherwise(extract_phones(text)))
