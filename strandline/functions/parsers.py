"""Parsers that read lines one after another with a state; they run on Arrow batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strandline.functions import markers

HEADER = re.compile(r"^(?:diff --git |index [0-9a-f]+\.\.|--- |\+\+\+ |@@ |new file mode|deleted file mode|similarity index|rename )")
BODY = re.compile(r"^[-+ \\]")
FILE_ERROR, ERROR, NOISE = (re.compile("|".join(p)) for p in (markers.LOG_FILE_ERRORS, markers.LOG_ERRORS, markers.LOG_NOISE))


def patch_by_state(text: str | None, misses: int = 3) -> str:
    """Lines from a patch's first header on; a patch ends with the `misses`-th line in a row that isn't a patch's."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for line in (text or "").split("\n"):
        if HEADER.match(line):
            out += held if inside else []
            held, inside = [], True
            out.append(line)
        elif inside and BODY.match(line):
            out += held
            held = []
            out.append(line)
        elif inside:
            held.append(line)
            if len(held) >= misses:
                held, inside = [], False
    return "\n".join(out)


def _relevant(lines: list[str], after: int, summary: int) -> Iterator[str]:
    """Of trimmed lines those about errors. A file error that ends another's context counts on its own once more."""
    shown = [i for i, x in enumerate(lines) if x and not NOISE.search(x)]
    at = 0
    while at < len(shown):
        i = shown[at]
        line, at = lines[i], at + 1
        if FILE_ERROR.search(line):
            yield line
            for _ in range(after):
                if at == len(shown):
                    return
                yield lines[shown[at]]
                if FILE_ERROR.search(lines[shown[at]]):
                    break
                at += 1
        elif ERROR.search(line) or "symbol:" in line or "location:" in line:
            yield line
        elif "FAILURE: Build failed" in line:
            yield line
            for x in filter(None, lines[i + 1 : i + summary]):
                yield x
                if "Try:" in x:
                    break


def relevant_log(text: str | None, after: int = 5, summary: int = 10, least: int = 500, tail: int = 10_000) -> str:
    """A build log's lines about errors; if they have fewer than `least` characters, a blank line and the log's last `tail` follow.

    Lines are trimmed; blank ones and noise are left out. A file error brings up to `after` lines behind it, with the
    next file error at most; a failure's summary brings the lines up to "Try:", fewer than `summary`.
    """
    found = "\n".join(_relevant([x.strip() for x in (text or "").split("\n")], after, summary))
    return found if len(found) >= least else found + "\n\n" + (text or "")[-tail:]


STARTS = [(re.compile(p), "{}") for p in markers.CLASS_BODIES] + [(re.compile(p), "()") for p in markers.CLASS_PARAMETERS]
MEMBERS = {k: re.compile(p) for k, p in (("field", markers.FIELD), ("method", markers.METHOD), ("constant", markers.CONSTANT))}
COMMENT = ("//", "*")


def _rise(line: str, pair: str) -> int:
    return line.count(pair[0]) - line.count(pair[1])


def class_bounds(lines: list[str]) -> tuple[int, int] | None:
    """The lines of the first class: to where its braces are even again, or its parentheses, where it begins with parameters; else to the end."""
    for i, line in enumerate(lines):
        pair = next((pair for pattern, pair in STARTS if pattern.match(line.strip())), None)
        if pair:
            depth = _rise(line, pair)
            for k in range(i + 1, len(lines)):
                depth += _rise(lines[k], pair)
                if depth == 0 and (pair == "{}" or lines[k].strip().endswith(")")):
                    return i, k
            return i, len(lines) - 1
    return None


def class_elements(source: str | None) -> list[dict]:
    """Fields outside methods, methods and constants of the first class: kind, name, signature, first and last line from 0.

    A member needs white space before its type, so one without a modifier isn't seen; names in title case are no methods.
    """
    lines = (source or "").split("\n")
    bounds = class_bounds(lines)
    if not bounds:
        return []
    begin, end = bounds
    trimmed = [x.strip() for x in lines]
    told = {k: [(i, m) for i in range(begin + 1, end) if trimmed[i] and (m := p.match(trimmed[i])) and (k == "constant" or not trimmed[i].startswith(COMMENT))] for k, p in MEMBERS.items()}
    inside, depth, busy = set(), 0, False
    for i in range(begin + 1, end):
        if not busy and MEMBERS["method"].match(trimmed[i]):
            busy, depth = True, 0
        if busy:
            depth += _rise(trimmed[i], "{}")
            busy = not (depth == 0 and i > begin + 1)
            if busy:
                inside.add(i)
    out = [_element("field", m[1], _field_signature(trimmed[i]), i, i) for i, m in told["field"] if i not in inside]
    after = begin
    for i, m in told["method"]:
        if i > after and not m[1].istitle():
            last = _body_end(lines, i, end)
            if last > i:
                out.append(_element("method", m[1], re.sub(r"\s+", " ", re.sub("//.*$", "", trimmed[i]).strip()).split("{")[0].strip(), i, last))
            after = last
    return out + [_element("constant", m[1], f"KEY_{m[1]}", i, i) for i, m in told["constant"]]


def _element(kind: str, name: str, signature: str, first: int, last: int) -> dict:
    return {"kind": kind, "name": name, "signature": signature, "first": first, "last": last}


def _field_signature(line: str) -> str:
    plain = re.sub(r"\s+", " ", re.sub("//.*$", "", line).strip())
    found = re.match(r"^(?:private|protected|public)?\s+(\w+(?:\[\])?)\s+(\w+)", plain)
    return f"{found[1]} {found[2]}" if found else plain


def _body_end(lines: list[str], begin: int, end: int) -> int:
    """The line at whose end the braces opened since begin are closed; begin if there is none."""
    depth, opened = 0, False
    for i in range(begin, end):
        opened |= "{" in lines[i]
        depth += _rise(lines[i], "{}")
        if opened and depth == 0:
            return i
    return begin


ELEMENT = StructType([StructField(n, StringType()) for n in ("kind", "name", "signature")] + [StructField(n, IntegerType()) for n in ("first", "last")])


@F.pandas_udf(ArrayType(ELEMENT))
def class_elements_udf(sources: pd.Series) -> pd.Series:
    return sources.map(class_elements)


@F.pandas_udf(StringType())
def patch_by_state_udf(texts: pd.Series) -> pd.Series:
    return texts.map(patch_by_state)


@F.pandas_udf(StringType())
def relevant_log_udf(texts: pd.Series) -> pd.Series:
    return texts.map(relevant_log)


def best_patch(answer: object) -> object:
    """Fenced blocks, else what the state machine finds, else lines that look like a diff's; cleaned."""
    from strandline.functions.extract import clean_patch, diff_lines

    fences = F.array_join(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?s)```(?:diff|patch)?[ \t]*\n((?:diff --git|---).*?)```"), 1)), "\n")
    by_state = patch_by_state_udf(answer)
    return clean_patch(F.coalesce(F.nullif(fences, F.lit("")), F.nullif(by_state, F.lit("")), diff_lines(answer), F.lit("")))
