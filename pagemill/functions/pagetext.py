"""Texts of pages outside columns: normal form, link lines with their blocks, folding."""

from __future__ import annotations

import difflib
import hashlib
import re
import textwrap
from dataclasses import dataclass, field

from pagemill.functions.links import HOST, LINK_LINE, NAME, NAME_REV, REV, SEGMENT, SYMBOL

_LINE = re.compile(LINK_LINE)
_DESCRIPTION = re.compile(r'(?:^|\s)(~?)"([^"]*)"$')
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
_ADDRESS = re.compile(
    rf"(?:sha256:[0-9A-Fa-f]{{12,64}}|(?:{HOST}/{SEGMENT}/{SEGMENT}/*@{REV}/+[^#@]+|{NAME}(?:@{NAME_REV})?)(?:\#{SYMBOL})?)\Z"
)


def normalized(text: str) -> str:
    """LF ends, no common margin, no white space at line ends, one newline at the end."""
    flat = textwrap.dedent(text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n+\Z", "", "\n".join(x.rstrip() for x in flat.split("\n"))) + "\n"


def digest(text: str) -> str:
    return hashlib.sha256(normalized(text).encode()).hexdigest()


@dataclass
class LinkLine:
    row: int
    indent: int
    relation: str
    address: str
    fields: dict[str, str] = field(default_factory=dict)
    description: str | None = None
    derived: bool = False
    start: int = 0
    stop: int = 0
    opener: str = "#"


def read_link(row: int, line: str) -> LinkLine | str | None:
    """A link line, what is wrong with a malformed one, or None for another line."""
    m = _LINE.match(line)
    if not m:
        return None
    body, said, derived = m[4], None, False
    if d := _DESCRIPTION.search(body):
        said, derived, body = d[2], d[1] == "~", body[: d.start()]
    words = body.split()
    if not words:
        return "no address"
    if not _ADDRESS.match(words[0]):
        return None  # some other comment that has a word and a colon
    if (m[2] == "/*") != bool(m[5]):
        return "a link in a block comment must close on its line"
    fields: dict[str, str] = {}
    for w in words[1:]:
        key, eq, value = w.partition("=")
        if not eq or '"' in value:
            return f"unexpected `{w}`"
        if not _KEY.match(key):
            return f"`{key}` is not a field name"
        if key in fields:
            return f"field `{key}` given twice"
        fields[key] = value
    relation = {"-from": "from", "-see": "see"}.get(m[3], "is")
    return LinkLine(row, len(m[1]), relation, words[0], fields, said, derived, opener=m[2])


def link_lines(lines: list[str]) -> list[LinkLine]:
    """The links of a file, each with the block beneath its stack: up to the next link, to a blank line that
    is followed by a line no deeper than the link, or to the end."""
    found = {k.row: k for i, x in enumerate(lines) if isinstance(k := read_link(i, x), LinkLine)}
    depth = [len(x) - len(x.lstrip(" \t")) if x.strip() else None for x in lines]
    ahead: list[int | None] = [None] * (len(lines) + 1)  # depth of the next line with text
    for i in range(len(lines) - 1, -1, -1):
        ahead[i] = depth[i] if depth[i] is not None else ahead[i + 1]
    for k in found.values():
        at = k.row + 1
        while at in found:
            at += 1
        k.start = at
        while at < len(lines) and at not in found and not (depth[at] is None and (ahead[at] is None or ahead[at] <= k.indent)):
            at += 1
        k.stop = at
    return list(found.values())


def own_text(lines: list[str]) -> tuple[list[str], list[LinkLine]]:
    """A page's lines without links and without stamped blocks, which are another page's; and those links."""
    links = link_lines(lines)
    if not links:
        return lines, []
    gone: set[int] = set()
    for k in links:
        gone.add(k.row)
        if k.relation == "is" and "id" in k.fields:
            gone |= set(range(k.start, k.stop))
            if k.stop < len(lines) and not lines[k.stop].strip():
                gone.add(k.stop)
    kept = [x for i, x in enumerate(lines) if i not in gone]
    while kept and not kept[0].strip():
        kept.pop(0)
    return kept, links


def folded(text: str, keep: frozenset[str] = frozenset()) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with the blocks beneath stamped is- and from-links left out, and (address, first line, last line) of each, from 1.

    Addresses in ``keep`` stay open.
    """
    lines = text.split("\n")
    out, entries, skip = [], [], set()
    for k in link_lines(lines):
        if k.relation in ("is", "from") and "id" in k.fields and k.stop > k.start and k.address not in keep:
            skip |= set(range(k.start, k.stop))
            entries.append((k.address, k.start + 1, k.stop))
    out = [x for i, x in enumerate(lines) if i not in skip]
    return "\n".join(out), entries


def block_status(lines: list[str], k: LinkLine, identity: str | None) -> str:
    """How a link's block compares with the page it names (``identity``, null where it cannot be found), the first that applies.

    unexpanded: an is-link without a stamp; drift: its block is not the stamp's text; unresolvable: the page cannot be
    found; mismatch: an is-link's page is not the stamp's; ok. Only is-links are held against their stamps.
    """
    stamp = k.fields.get("id", "").removeprefix("sha256:").lower()
    if k.relation == "is":
        if not stamp:
            return "unexpanded"
        if k.stop <= k.start or not digest("\n".join(lines[k.start : k.stop])).startswith(stamp):
            return "drift"
    if identity is None:
        return "unresolvable"
    return "mismatch" if k.relation == "is" and not identity.startswith(stamp) else "ok"


def fixed(lines: list[str], found: dict[str, str]) -> tuple[list[str], list[tuple[int, str, str]]]:
    """The lines with drifted is-links turned into from-links, and (line from 1, address, status) of every link; ``found`` maps addresses to identities.

    The address and the stamp stay, the code beneath is its owner's from then on; such links are reported as 'fixed'.
    """
    out, told = list(lines), []
    for k in link_lines(lines):
        status = block_status(lines, k, found.get(k.address))
        if status == "drift":
            out[k.row] = re.sub(r"^(\s*(?:#|//|--|;+|/\*)[ \t]*[a-z]+):", r"\1-from:", out[k.row], count=1)
            status = "fixed"
        told.append((k.row + 1, k.address, status))
    return out, told


def stamped(address: str, identity: str, description: str | None = None, opener: str = "#", marker: str = "link", derived: bool = False) -> str:
    """A link line with its stamp: the first twelve digits of the page's identity."""
    said = f'  {"~" if derived else ""}"{description.replace(chr(34), chr(39))}"' if description else ""
    return f"{opener} {marker}: {address} id={identity[:12]}{said}" + (" */" if opener == "/*" else "")


def expanded(text: str, pages: dict[str, list[tuple[str, str]]], statements: dict[str, list[str]] | None = None) -> tuple[str, list[str]]:
    """A text with the closure of each unstamped is-link written beneath it, and the addresses that could not be.

    ``pages`` maps an address to its closure, dependencies first, as (identity, source); the last one is the page
    itself, whose identity becomes the stamp. A page that an earlier link of the text wrote is not written
    again. Import ``statements`` by address are put once above the first link that needs them.
    """
    lines = text.split("\n")
    links = {k.row: k for k in link_lines(lines)}
    out, missing = [], []
    written: set[str] = set()
    said: set[str] = set(lines)
    for row, line in enumerate(lines):
        k = links.get(row)
        if k is None or k.relation != "is" or "id" in k.fields:
            out.append(line)
            continue
        closure = pages.get(k.address)
        if not closure:
            missing.append(k.address)
            out.append(line)
            continue
        pad = " " * k.indent
        for s in (statements or {}).get(k.address, []):
            if s not in said:
                out.append(pad + s)
                said.add(s)
        stamp = f" id={closure[-1][0][:12]}"
        head = line.rstrip()
        cut = head.find(k.address) + len(k.address)
        body = [src for identity, src in closure if identity not in written]
        written |= {identity for identity, _ in closure}
        out.append(head[:cut] + stamp + head[cut:])
        block = "\n\n".join(src.rstrip("\n") for src in body)
        out += [pad + x if x else x for x in block.split("\n")] if body else []
        if body and row + 1 < len(lines) and lines[row + 1].strip():
            out.append("")
    return "\n".join(out), missing


def with_link(text: str, address: str, row: int | None = None, marker: str = "link", opener: str = "#") -> str:
    """A text with a link line before ``row`` (from 1), at its indent, or at the end."""
    lines = text.split("\n")
    at = len(lines) - (lines[-1] == "") if row is None else max(0, min(row - 1, len(lines)))
    pad = re.match(r"[ \t]*", lines[at])[0] if at < len(lines) else ""
    lines.insert(at, f"{pad}{opener} {marker}: {address}" + (" */" if opener == "/*" else ""))
    return "\n".join(lines)


def moved_stamp(old: LinkLine, current: tuple[str, str] | None) -> tuple[str, str] | None:
    """(address, identity) that a stamped link should carry now, None where it is current or tracks nothing; see-links never move."""
    if old.relation == "see" or current is None or not old.fields.get("id"):
        return None
    address, identity = current
    return None if identity.startswith(old.fields["id"].removeprefix("sha256:").lower()) and address == old.address else (address, identity)


def text_diff(old: str, new: str, old_name: str, new_name: str) -> str:
    """A unified diff with two lines around each change, '' for equal texts."""
    return "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), old_name, new_name, lineterm="", n=2))


def same_page(one: str, other: str) -> bool:
    """Whether two addresses name one page, whatever their revisions."""
    bare = lambda a: re.sub(r"@[^/#]+", "", a.strip(), count=1) if "/" in a.split("#")[0].split("@")[0] else re.sub(r"@[^#]+", "", a.strip(), count=1)
    return bare(one) == bare(other)


def distribution(requirement: str) -> str:
    """The name a requirement asks for, as indexes of packages write it."""
    return re.match(r"[^\s\[<>=!~;@]*", requirement.strip())[0].lower().replace("_", "-")


def module_name(name: str | None, target: str, path: str, symbol: str | None) -> str:
    """A module name for a page written into a folder of its own: from its registry name, else its repository and file."""
    words = [name or f"{target.split('/')[2]}_{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}", *([symbol] if symbol else [])]
    plain = re.sub(r"\W+", "_", "_".join(words), flags=re.ASCII).strip("_").lower()
    return (plain if plain[:1].isalpha() or plain[:1] == "_" else f"_{plain}") if plain else "page"


def packaged(address: str, closure: list[tuple[str, str]], statements: list[str], module: str, binds: list[str], folder: str = "vendored") -> tuple[str, str]:
    """(text of a module, import line) for a closure that is kept in a file of its own: imports, what it needs, and the page beneath its stamp.

    ``closure`` is (identity, source), dependencies first.
    """
    *needed, (identity, source) = closure
    parts = [*([chr(10).join(statements)] if statements else []), *[text.rstrip("\n") for _, text in needed], stamped(address, identity) + "\n" + source.rstrip("\n")]
    said = f"from {folder}.{module} import {', '.join(binds)}" if binds else f"import {folder}.{module}"
    return "\n\n\n".join(parts) + "\n", said


@dataclass
class Move:
    """What following a link would change: status, what is said of it, the diff, and the lines that would take the place of those from ``first`` to ``last``."""

    row: int
    address: str
    status: str
    message: str
    diff: str = ""
    first: int = 0
    last: int = 0
    lines: list[str] = field(default_factory=list)


def tracked(lines: list[str], addresses: tuple[str, ...] = (), every: bool = False) -> list[LinkLine]:
    """Links that an update looks at: those of the pages named, else all, else those marked ``track=latest``; never see-links."""
    links = [k for k in link_lines(lines) if k.relation != "see"]
    if addresses:
        return [k for k in links if any(same_page(k.address, a) for a in addresses)]
    return links if every else [k for k in links if k.fields.get("track") == "latest"]


def planned(lines: list[str], k: LinkLine, head: tuple[str, str, str] | None, pinned: tuple[str, str] | None = None) -> Move:
    """What following a stamped link would change; nothing is changed.

    ``head`` is (address, identity, source) of the page as it is now, ``pinned`` (identity, source) as it was when a from-link was
    written. Only an is-link with an unedited block moves; a from-link's code is its owner's, who is shown the upstream change.
    """
    at = k.row + 1
    stamp = k.fields.get("id", "").removeprefix("sha256:").lower()
    if not stamp:
        return Move(at, k.address, "unexpanded", "not expanded yet")
    if "vendor" in k.fields:
        return Move(at, k.address, "vendored", f"kept in {k.fields['vendor']}")
    if head is None:
        return Move(at, k.address, "not-found", "its page cannot be found")
    address, identity, source = head
    if k.relation == "from":
        if pinned and pinned[0] == identity:
            return Move(at, k.address, "upstream", "no upstream change")
        return Move(at, k.address, "upstream", "upstream has changed", text_diff(pinned[1] if pinned else "", source, k.address, address))
    block = "\n".join(lines[k.start : k.stop])
    if not digest(block).startswith(stamp):
        return Move(at, k.address, "drift", "the code beneath was edited")
    if identity.startswith(stamp):
        return Move(at, k.address, "unchanged", f"the same at {address}")
    pad = " " * k.indent
    # the length of the digits stays, fields and descriptions too
    line = lines[k.row].replace(k.address, address, 1).replace(k.fields["id"], k.fields["id"][: len(k.fields["id"]) - len(stamp)] + identity[: len(stamp)], 1)
    body = [pad + x if x else x for x in source.rstrip("\n").split("\n")]
    between = lines[k.row + 1 : k.start]
    return Move(at, k.address, "updated", f"{k.address} to {address}", text_diff(normalized(block), source, k.address, address), k.row, k.stop, [line, *between, *body])


def moved(lines: list[str], moves: list[Move]) -> list[str]:
    """The lines with all moves applied, from below to above so that rows stay right."""
    out = list(lines)
    for m in sorted((m for m in moves if m.status == "updated"), key=lambda m: -m.first):
        out[m.first : m.last] = m.lines
    return out
