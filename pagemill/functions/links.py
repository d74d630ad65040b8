"""Link lines and addresses.

A link line is a whole-line comment ``marker: address [key=value ...] [~]["description"]``.
The marker is a word, alone (the code beneath is that page), or with ``-from`` (derived
from it) or ``-see`` (a reference). An address is a name ``label.label@version#symbol``, a locator
``host/owner/repo@rev/path#symbol`` or an identity ``sha256:hex``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the grammar of addresses
NAME = r"[a-z0-9]+(?:-[a-z0-9]+)*(?:\.[a-z0-9]+(?:-[a-z0-9]+)*)*"
NAME_REV = r"[A-Za-z0-9._/-]+"
REV = r"[A-Za-z0-9._-]+"
HOST = r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]+)?"
SEGMENT = r"[A-Za-z0-9._-]+"
SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
IDENTITY_NAME = r"(?:sha256:)([0-9A-Fa-f]{12,64})"
MARKER = r"[a-z]{2,12}"

_LOCATOR = rf"({HOST})/({SEGMENT})/({SEGMENT})/*@({REV})/+([^#@]*[^#@/])/*"
LINK_LINE = rf'^([ \t]*)(#|//|--|;+|/\*)[ \t]*{MARKER}(-from|-see)?:[ \t]*(.*?)[ \t]*(\*/)?[ \t]*$'
#: a comment line that links, told by what follows its marker
LINK = re.compile(rf"^\W*{MARKER}(?:-from|-see)?:[ \t]+(?:{HOST}/{SEGMENT}/{SEGMENT}@|sha256:[0-9A-Fa-f]{{6}}|[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:[@#\s]|$))")

ADDRESS = "struct<form:string,name:string,locator:string,path:string,rev:string,symbol:string,identity:string>"


def address(text: Column | str) -> Column:
    """An address as a struct of its parts, null where it does not parse.

    Hosts, commit hashes and identities are put in lower case; back slashes before a symbol are read as slashes.
    """
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    head = F.translate(F.substring_index(c, "#", 1), "\\", "/")
    has_symbol = F.contains(c, F.lit("#"))
    symbol = F.when(has_symbol, F.substring(c, F.length(F.substring_index(c, "#", 1)) + 2, F.length(c)))
    symbol_ok = ~has_symbol | F.coalesce(symbol.rlike(rf"^{SYMBOL}$"), F.lit(False))
    none = F.lit(None).cast("string")

    def lowered(rev: Column) -> Column:
        return F.when(rev.rlike("^[0-9A-Fa-f]{12,40}$"), F.lower(rev)).otherwise(rev)

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(head, f"^{pattern}$", n)

    path = part(_LOCATOR, 5)
    path_ok = ~path.rlike(r"(?:^|/)(?:|\.|\.\.)(?:/|$)")
    is_identity = c.rlike(rf"^{IDENTITY_NAME}$")
    is_locator = head.rlike(f"^{_LOCATOR}$") & path_ok & symbol_ok
    name_form = rf"({NAME})(?:@({NAME_REV}))?"
    is_name = head.rlike(f"^{name_form}$") & symbol_ok & ~F.contains(F.substring_index(head, "@", 1), F.lit("/"))
    rev = part(name_form, 2)
    fields = ("form", "name", "locator", "path", "rev", "symbol", "identity")

    def built(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, fields)])

    return (
        F.when(is_identity, built(F.lit("identity"), none, none, none, none, none, F.lower(F.regexp_extract(c, f"^{IDENTITY_NAME}$", 1))))
        .when(is_locator, built(F.lit("locator"), none, F.concat_ws("/", F.lower(part(_LOCATOR, 1)), part(_LOCATOR, 2), part(_LOCATOR, 3)), path, lowered(part(_LOCATOR, 4)), symbol, none))
        .when(is_name, built(F.lit("name"), part(name_form, 1), none, none, F.when(rev != "", lowered(rev)), symbol, none))
    )


def pinned(addr: Column) -> Column:
    """Whether an address can never change what it names: an identity, or a commit hash."""
    return (addr["form"] == "identity") | F.coalesce(addr["rev"].rlike("^[0-9a-f]{12,40}$"), F.lit(False))


def format_address(addr: Column) -> Column:
    """The canonical text of an address struct."""
    at = F.when(addr["rev"].isNotNull(), F.concat(F.lit("@"), addr["rev"])).otherwise("")
    sym = F.when(addr["symbol"].isNotNull(), F.concat(F.lit("#"), addr["symbol"])).otherwise("")
    return (
        F.when(addr["form"] == "identity", F.concat(F.lit("sha256:"), addr["identity"]))
        .when(addr["form"] == "locator", F.concat(addr["locator"], at, F.lit("/"), addr["path"], sym))
        .otherwise(F.concat(addr["name"], at, sym))
    )


def link(line: Column | str) -> Column:
    """A link line as struct<relation, address, fields, description, derived, indent>; null for other and malformed lines."""
    c = F.col(line) if isinstance(line, str) else line
    body = F.regexp_extract(c, LINK_LINE, 4)
    description = r'(?:^|\s)(~?)"([^"]*)"$'
    has = body.rlike(description)
    rest = F.when(has, F.regexp_replace(body, rf"\s*{description}", "")).otherwise(body)
    words = F.filter(F.split(rest, r"\s+"), lambda w: w != "")
    keys = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    well = (
        c.rlike(LINK_LINE) & (F.size(words) > 0) & ~F.element_at(words, 1).rlike('["~]')
        & F.forall(keys, lambda w: w.rlike('^[A-Za-z_][A-Za-z0-9_-]*=[^"]*$'))
        & (F.size(F.array_distinct(F.transform(keys, lambda w: F.substring_index(w, "=", 1)))) == F.size(keys))
        & ((F.regexp_extract(c, LINK_LINE, 2) == "/*") == (F.regexp_extract(c, LINK_LINE, 5) == "*/"))
    )
    marker = F.regexp_extract(c, LINK_LINE, 3)
    relation = F.when(marker == "-from", "from").when(marker == "-see", "see").otherwise("is")
    pairs = F.transform(keys, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v")))
    return F.when(
        well,
        F.struct(
            relation.alias("relation"), F.element_at(words, 1).alias("address"), F.map_from_entries(pairs).alias("fields"),
            F.when(has, F.regexp_extract(body, description, 2)).alias("description"), F.when(has, F.regexp_extract(body, description, 1) == "~").alias("derived"),
            F.length(F.regexp_extract(c, LINK_LINE, 1)).alias("indent"),
        ),
    )
