"""Normal form and identity of a text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what counts as white space at a line's end
_TRAILING = "[\\x09-\\x0d\\x1c-\\x1f\\x85\\p{Z}]+\\z"


def normalize(text: Column | str) -> Column:
    """LF line ends, common margin removed, no white space at line ends, no blank lines at the end, one final newline.

    Lines of blanks and tabs alone do not count for the margin. Null stays null; an empty text gives one newline.
    """
    c = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(c, "\\r\\n|\\r|\\n", -1), lambda x: F.when(x.rlike("\\A[ \\t]+\\z"), F.lit("")).otherwise(x))
    margins = F.transform(F.filter(lines, lambda x: x.rlike("[^ \\t]")), lambda x: F.regexp_extract(x, "\\A[ \\t]*", 0))
    # what the least and the greatest margin begin with in common, all begin with
    ends = F.struct(lines.alias("lines"), F.array_min(margins).alias("low"), F.array_max(margins).alias("high"))

    def stripped(s: Column) -> Column:
        agree = F.filter(
            F.sequence(F.lit(0), F.coalesce(F.least(F.length(s["low"]), F.length(s["high"])), F.lit(0))),
            lambda n: F.substring(s["low"], F.lit(1), n) == F.substring(s["high"], F.lit(1), n),
        )
        width = F.coalesce(F.array_max(agree), F.lit(0))
        # bound by a one-element array, the width is worked out once a text and not once a line
        return F.element_at(
            F.transform(F.array(width), lambda w: F.transform(s["lines"], lambda x: F.regexp_replace(F.when(x == "", x).otherwise(F.substring(x, w + 1, F.length(x))), _TRAILING, ""))), 1
        )

    clean = F.element_at(F.transform(F.array(ends), lambda s: F.array_join(stripped(s), "\n")), 1)
    return F.concat(F.regexp_replace(clean, "\\n+\\z", ""), F.lit("\n"))


def identity(text: Column | str) -> Column:
    """SHA-256 hex of the normal form."""
    return F.sha2(normalize(text), 256)


def short(digest: Column | str) -> Column:
    """The first twelve hex digits."""
    return F.substring(digest, 1, 12)


#: fixed values: phrases that identify a licence text; the second member tells whether they stand in its head
LICENSE_PHRASES = [
    ("Apache-2.0", ["apache license", "version 2.0"], True),
    ("MPL-2.0", ["mozilla public license", "2.0"], True),
    ("GPL-3.0", ["gnu general public license", "version 3"], True),
    ("GPL-2.0", ["gnu general public license", "version 2"], True),
    ("MIT", ["permission is hereby granted, free of charge, to any person obtaining a copy"], False),
    ("ISC", ["permission to use, copy, modify, and/or distribute this software for any purpose"], False),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name"], False),
    ("BSD-2-Clause", ["redistribution and use in source and binary forms"], False),
]
LICENSE_HEAD = 2000
_GNU = ["gnu general public license", "gnu lesser general public license", "gnu affero general public license"]


def spdx(text: Column | str) -> Column:
    """The SPDX id of a licence text by its phrases, null when none fits. Of the GNU titles the first in the head decides."""
    c = F.col(text) if isinstance(text, str) else text
    flat = F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    head = F.substring(flat, 1, LICENSE_HEAD)
    at = [F.nullif(F.instr(head, t), F.lit(0)) for t in _GNU]
    general_first = F.coalesce(at[0] == F.least(*at), F.lit(False))
    from_title = F.when(general_first, F.substring(head, at[0], F.lit(LICENSE_HEAD)))
    out = None
    for name, phrases, in_head in LICENSE_PHRASES:
        where = from_title if name.startswith("GPL") else head if in_head else flat
        cond = F.lit(True)
        for p in phrases:
            cond = cond & F.coalesce(F.contains(where, F.lit(p)), F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def language_of(path: Column | str) -> Column:
    """python, c or text by what follows the last dot of the file name."""
    name = F.substring_index(path, "/", -1)
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    return F.when(ending == "py", "python").when(ending.isin("c", "h"), "c").otherwise("text")
