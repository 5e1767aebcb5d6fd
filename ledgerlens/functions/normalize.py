"""Normalisers: phone, address, web address and business name, as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import matching, vocab

EDGE = " ,;|-"


def text(c: Column) -> Column:
    """Trimmed text, empty for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


#: Letters with marks (Latin) and the bare letters they decompose to, by the Unicode rule.
_MARKED = [(chr(k), d[0].lower()) for k in range(0xC0, 0x250) for d in [unicodedata.normalize("NFKD", chr(k))] if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]


def folded(c: Column) -> Column:
    """Lower case without the marks of Latin letters; what has no single base letter stays."""
    return F.translate(F.lower(text(c)), "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def first_contained(haystack: Column, words: list[str]) -> Column:
    """The first word of the list, in list order, that the text contains; null if none. Long lists must stand outside lambdas."""
    if len(words) >= matching.AUTOMATON_FROM:
        return matching.first_of(haystack, words)
    return let(haystack, lambda h: F.get(F.filter(literals(words), lambda w: F.contains(h, w)), 0))


def any_contained(haystack: Column, words: list[str]) -> Column:
    if len(words) >= matching.AUTOMATON_FROM:
        return matching.any_of(haystack, words)
    return let(haystack, lambda h: F.exists(literals(words), lambda w: F.contains(h, w)))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once; written out, nested steps would double at every use."""
    return F.get(F.transform(F.array(value), then), 0)


def once(value: Column) -> Column:
    """value in a form that the optimizer does not copy into each of its uses."""
    return let(value, lambda x: x)


def phone(raw: Column, trunk_zero: bool = True) -> Column:
    """struct(raw, e164, national, digits, is_voip, is_mobile, area_code, pbx_prefix_6).

    trunk_zero drops the 0 of "+31 (0)20 …"; without it that zero is doubled.
    """
    value = F.regexp_replace(F.trim(F.regexp_replace(text(raw), vocab.PHONE_EXTENSION, "")), vocab.PHONE_LABEL, "")
    codes = [c for c in vocab.AREA_CODES if len(c) == 4]

    def numbers(dialled: Column) -> Column:
        """national and e164 of digits with an optional leading +."""
        digits = F.regexp_replace(dialled, r"\D", "")
        rest = F.substring(digits, 3, 40)
        rest = F.when(rest.startswith("0"), F.substring(rest, 2, 40)).otherwise(rest) if trunk_zero else rest
        abroad, bare = dialled.startswith("+"), digits.startswith("31") & (F.length(digits) >= 10) & ~digits.startswith("310")
        dutch = (abroad & digits.startswith("31")) | (~abroad & bare)
        national = F.when(dutch, F.concat(F.lit("0"), rest)).when(abroad, F.lit("")).otherwise(digits)
        e164 = (
            F.when(dutch, F.concat(F.lit("+31"), rest)).when(abroad & (digits != ""), F.concat(F.lit("+"), digits))
            .when(~abroad & digits.startswith("0") & (F.length(digits) >= 9), F.concat(F.lit("+31"), F.substring(digits, 2, 40))).otherwise("")
        )
        return F.struct(national.alias("n"), e164.alias("e"))

    def area(n: Column) -> Column:
        return (
            F.when(n.startswith("06"), F.lit("06")).when(F.substring(n, 1, 3).isin(*vocab.NON_GEOGRAPHIC), F.substring(n, 1, 3))
            .when(F.substring(n, 1, 4).isin(*codes), F.substring(n, 1, 4)).when(F.substring(n, 1, 1) == "0", F.substring(n, 1, 3)).otherwise("")
        )

    def parts(x: Column) -> Column:
        n, code = x["n"], x["a"]
        shown = F.when((code != "") & (F.length(n) > F.length(code)), F.concat(code, F.lit("-"), F.substr(n, F.length(code) + 1))).otherwise(n)
        return F.struct(
            x["raw"].alias("raw"), x["e"].alias("e164"), shown.alias("national"), n.alias("digits"),
            F.substring(n, 1, 3).isin(*vocab.NON_GEOGRAPHIC).alias("is_voip"), n.startswith("06").alias("is_mobile"),
            code.alias("area_code"), F.substring(n, 1, 6).alias("pbx_prefix_6"),
        )

    compact = let(F.regexp_replace(value, r"[^\d+]", ""), lambda c: F.when(c.startswith("00"), F.concat(F.lit("+"), F.substring(c, 3, 40))).otherwise(c))
    known = let(compact, numbers)
    return let(let(known, lambda x: F.struct(text(raw).alias("raw"), x["n"].alias("n"), x["e"].alias("e"), area(x["n"]).alias("a"))), parts)


def _edged(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGE))


POSTAL = r"(?i)(?<![A-Z0-9])(\d{4})\s*([A-Z]{2})(?![A-Z0-9])"
HOUSE = r"(?U)(?<!\w)(\d{1,6})(?:\s*([A-Za-z]{1,4}))?(?:\s*[-/]\s*([A-Za-z0-9]{1,8}))?(?!\w)"
COUNTRY = r"(?i)(?:,|\s)\s*(?:the\s+)?(?:netherlands|nederland|nl)\s*$"


def address(raw: Column) -> Column:
    """struct(raw, postal_code, house_number, addition, street, city, country, normalized_key)."""
    def landless(c: Column) -> Column:
        return F.when(F.regexp_extract(c, COUNTRY, 0) != "", _edged(F.regexp_replace(c, COUNTRY, ""))).otherwise(c)

    def around(x: Column) -> Column:
        """What stands before and after the postal code."""
        work, hit = x["work"], x["hit"]
        at = F.instr(work, hit)
        return F.struct(
            hit.alias("hit"), F.when(hit != "", _edged(F.substr(work, F.lit(1), at - 1))).otherwise(work).alias("before"),
            F.when(hit != "", _edged(F.substr(work, at + F.length(hit)))).otherwise("").alias("after"),
        )

    def town(x: Column) -> Column:
        before = F.when(x["after"] == "", landless(x["before"])).otherwise(x["before"])
        return let(F.struct(x["hit"].alias("hit"), before.alias("before"), landless(x["after"]).alias("after")), lambda y: F.struct(
            y["hit"].alias("hit"), y["before"].alias("before"), y["after"].alias("after"),
            F.when(y["hit"] == "", F.regexp_extract(y["before"], r",\s*([^,]+)$", 1)).otherwise("").alias("tail"),
        ))

    def street(x: Column) -> Column:
        postal = F.when(x["hit"] != "", F.concat(F.substring(x["hit"], 1, 4), F.lit(" "), F.upper(F.substring(x["hit"], -2, 2)))).otherwise("")
        part = F.when(x["tail"] != "", _edged(F.regexp_replace(x["before"], r",\s*[^,]+$", ""))).otherwise(x["before"])
        city = F.when(x["tail"] != "", F.trim(x["tail"])).otherwise(_edged(x["after"]))
        return let(part, lambda p: F.struct(
            postal.alias("postal"), city.alias("city"), p.alias("part"), F.regexp_extract(p, HOUSE, 0).alias("found"), F.regexp_extract(p, HOUSE, 1).alias("number"),
            F.upper(F.concat(F.regexp_extract(p, HOUSE, 2), F.regexp_extract(p, HOUSE, 3))).alias("addition"),
        ))

    def done(x: Column) -> Column:
        at = F.instr(x["part"], x["found"])
        rest = F.concat(F.substr(x["part"], F.lit(1), at - 1), F.substr(x["part"], at + F.length(x["found"])))
        key = F.regexp_replace(F.lower(F.concat(x["postal"], x["number"], x["addition"])), "[^a-z0-9]", "")
        return F.struct(
            text(raw).alias("raw"), x["postal"].alias("postal_code"), x["number"].alias("house_number"), x["addition"].alias("addition"),
            _edged(F.when(x["number"] != "", rest).otherwise(x["part"])).alias("street"), x["city"].alias("city"), F.lit("NL").alias("country"), key.alias("normalized_key"),
        )

    work = F.trim(F.regexp_replace(text(raw), r"\s+", " "))
    first = let(work, lambda w: F.struct(w.alias("work"), F.regexp_extract(w, POSTAL, 0).alias("hit")))
    return let(let(let(let(first, around), town), street), done)


@F.pandas_udf(T.StringType())
def idna(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """ASCII form of host names; names that have none stay."""

    def one(host: str | None) -> str | None:
        try:
            return host.encode("idna").decode("ascii") if host else host
        except UnicodeError:
            return host

    for batch in hosts:
        yield batch.map(one)


def domain(raw: Column, international: bool = False) -> Column:
    """struct(raw, canonical_url, domain, subdomain, scheme).

    international: non-ASCII host names are put in their ASCII form (a vectorised UDF);
    without it the whole expression stays in generated code.
    """
    def split(full: Column) -> Column:
        rest = F.regexp_replace(full, r"^[^:]+://", "")
        authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""), r"\.+$", ""))
        return F.struct(
            F.lower(F.regexp_extract(full, r"^([^:]+)://", 1)).alias("scheme"), host.alias("host"),
            F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def labelled(x: Column) -> Column:
        labels = F.filter(F.split(x["host"], r"\."), lambda p: p != "")
        return let(labels, lambda p: F.struct(
            p.alias("labels"), F.size(p).alias("n"),
            F.when(F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), ".").isin(*vocab.TWO_LABEL_SUFFIXES), 3).otherwise(2).alias("width"),
        ))

    def done(x: Column) -> Column:
        u, p = x["u"], x["p"]
        enough = p["n"] >= p["width"]
        name = F.when(enough, F.array_join(F.slice(p["labels"], F.greatest(p["n"] - p["width"] + 1, F.lit(1)), p["width"]), ".")).otherwise(u["host"])
        sub = F.when(enough, F.array_join(F.slice(p["labels"], F.lit(1), F.greatest(p["n"] - p["width"], F.lit(0))), ".")).otherwise("")
        scheme = F.when(u["scheme"].isin("http", "https"), u["scheme"]).otherwise("https")
        kept = F.filter(F.split(u["query"], "&"), lambda q: (q != "") & ~F.regexp_like(F.substring_index(q, "=", 1), F.lit(vocab.TRACKING_KEYS)))
        kept = F.array_join(F.transform(kept, lambda q: F.when(F.contains(q, F.lit("=")), q).otherwise(F.concat(q, F.lit("=")))), "&")
        asked = let(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise(""))
        return F.struct(
            text(raw).alias("raw"), F.concat(scheme, F.lit("://"), u["host"], u["path"], asked).alias("canonical_url"), name.alias("domain"),
            F.regexp_replace(F.regexp_replace(sub, r"^www$", ""), r"^www\.", "").alias("subdomain"), scheme.alias("scheme"),
        )

    value = text(raw)
    full = F.when(F.regexp_like(value, F.lit(r"^(?i)[a-z][a-z0-9+.-]*://")), value).otherwise(F.concat(F.lit("https://"), value))
    parsed = let(full, split)
    if international:  # UDFs cannot stand inside the steps
        host = F.when(F.regexp_like(parsed["host"], F.lit(r"[^\x00-\x7F]")), idna(parsed["host"])).otherwise(parsed["host"])
        parsed = F.struct(parsed["scheme"].alias("scheme"), host.alias("host"), parsed["path"].alias("path"), parsed["query"].alias("query"))
    return let(let(parsed, lambda u: F.struct(u.alias("u"), labelled(u).alias("p"))), done)


_LEGAL = re.compile(vocab.LEGAL_SUFFIX, re.I)
_TAIL = re.compile(r"\s*[-|,:/]\s*(?:in|te|bij|regio)\s+(.+)$", re.I)
_NAME_EDGE = " \t\r\n,;|:-/"


#: Types are spelled out, as workers that import this module cannot parse type strings.
NAME = (
    T.StructType().add("clean_name", T.StringType()).add("tokens", T.ArrayType(T.StringType()))
    .add("brand_guess", T.StringType()).add("has_delimiters", T.BooleanType())
)


def split_name(raw: str | None) -> dict[str, object]:
    """clean_name, tokens, brand_guess, has_delimiters of one name."""
    value = (raw or "").strip()
    clean = re.sub(r"\s+", " ", re.sub(r"[|]+", " ", unicodedata.normalize("NFKC", value))).strip(_NAME_EDGE)
    brand = _TAIL.sub("", _LEGAL.sub("", clean).strip(_NAME_EDGE)).strip(_NAME_EDGE)
    return {"clean_name": clean, "tokens": re.findall(r"[^\W_]+", clean.lower()), "brand_guess": brand, "has_delimiters": bool(re.search(r"[|:/-]", value))}


@F.pandas_udf(NAME)
def business_name(names: pd.Series) -> pd.DataFrame:
    """Unicode compatibility folding has no built-in function, hence a vectorised UDF."""
    return pd.DataFrame(list(names.map(split_name)), columns=["clean_name", "tokens", "brand_guess", "has_delimiters"])


def compact(value: str | None) -> str:
    """Accents, case and everything but letters and digits taken away."""
    folded = unicodedata.normalize("NFKD", value or "")
    return "".join(c for c in folded if not unicodedata.combining(c) and c.isalnum()).casefold()


@F.pandas_udf(T.StringType())
def compacted(values: pd.Series) -> pd.Series:
    return values.map(compact)


# The other dialects of phone, website and address keys.
def plain_phone(raw: Column, least: int = 9, rewrite_from: int = 11) -> Column:
    """Digits with a leading 31 of a number of rewrite_from digits or more as 0; null under `least` digits."""
    local = lambda d: F.when(d.startswith("31") & (F.length(d) >= rewrite_from), F.concat(F.lit("0"), F.substring(d, 3, 40))).otherwise(d)
    return let(let(F.regexp_replace(text(raw), r"\D", ""), local), lambda n: F.when(F.length(n) >= least, n))


def plain_host(raw: Column) -> Column:
    """Host name without www, null if none."""
    host = F.lower(F.regexp_extract(F.regexp_replace(text(raw), r"^(?i)[a-z]+://", ""), r"^(?:[^@/?#]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(F.btrim(host, F.lit(".")), r"^www\.", ""), F.lit(""))


def plain_address(raw: Column) -> Column:
    """Letters and digits of the whole address; null for placeholders."""
    key = F.regexp_replace(F.lower(text(raw)), "[^a-z0-9]", "")
    return F.when(~key.isin("", "addressunverified", "onbekend"), key)


def hub_address(raw: Column) -> Column:
    """As plain_address, only if over five characters and not a placeholder anywhere."""
    key = F.regexp_replace(F.lower(text(raw)), "[^a-z0-9]", "")
    return F.when((F.length(key) > 5) & ~F.contains(key, F.lit("addressunverified")), key)


def words_of_name(c: Column) -> Column:
    """Lower-case words of a name, for comparing titles."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " ")), " "), lambda w: w != "")


def names_differ(expected: Column, actual: Column) -> Column:
    """Whether two titles differ: neither holds the other and under 0.4 of the words are shared."""
    a, b = F.array_distinct(words_of_name(expected)), F.array_distinct(words_of_name(actual))
    x, y = F.array_join(words_of_name(expected), " "), F.array_join(words_of_name(actual), " ")
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when((x == "") | (y == "") | F.contains(x, y) | F.contains(y, x), False).otherwise(overlap < 0.4)


def policy_id(key: Column) -> Column:
    """The policy that a violation key names, directly or by alias; null if unknown."""
    upper = F.regexp_replace(F.upper(text(key)), "[_ ]", "-")
    aliases = F.create_map(*[F.lit(x) for kv in vocab.POLICY_ALIASES.items() for x in kv])
    known = [p[0] for p in vocab.POLICIES]
    return F.when(upper.isin(*known), upper).otherwise(F.try_element_at(aliases, upper))


def place_id(place_key: Column, url: Column, name: Column, address_: Column) -> Column:
    """A place key, else the URL if it carries one, else a hash of name and address."""
    derived = F.concat(F.lit("v1_"), F.substring(F.md5(F.concat(text(name), F.lit("_"), text(address_))), 1, 16))
    return F.coalesce(F.nullif(text(place_key), F.lit("")), F.when(F.contains(text(url), F.lit("1s0x")), text(url)), derived)


def place_key(url: Column) -> Column:
    found = F.regexp_extract(text(url), r"1s(0x[0-9a-f]+:0x[0-9a-f]+)", 1)
    return F.when(found != "", found).otherwise(text(url))


def case_number(message: Column) -> Column:
    return F.nullif(F.regexp_extract(text(message), r"\b([0-9]-[0-9]{10,16})\b", 1), F.lit(""))


def safe_slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), "[^A-Za-z0-9_-]", "_"))


def shortened(c: Column, limit: int = 98, keep: int = 95) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def composed_address(street: Column, number: Column, postal: Column, city: Column, country: Column) -> Column:
    """The filled parts of an address, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(text(c), F.lit("")) for c in (street, number, postal, city, country)])


#: The public map address and its search form (fixed values).
MAPS, MAPS_SEARCH = "https://www.google.com/maps", "https://www.google.com/maps/search/?api=1&query="


def public_maps_url(url: Column, name: Column) -> Column:
    """A listing's public map address: country host rewritten, query dropped unless it is a search; a search for the name by default."""
    search = F.concat(F.lit(MAPS_SEARCH), F.coalesce(name, F.lit("")))
    world = F.replace(F.coalesce(url, F.lit("")), F.lit("google.nl/maps"), F.lit("google.com/maps"))
    bare = F.when(F.contains(world, F.lit("api=1")), world).otherwise(F.substring_index(world, "?", 1))
    return F.when(F.startswith(bare, F.lit(MAPS)), bare).otherwise(search)
