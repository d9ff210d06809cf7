"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard
parser evaluates the and/or/with expressions that follow the tags.

Texts are lower-cased (A-Z only) and split into words of ASCII letters, digits and non-ASCII bytes.
The words, joined by single spaces and framed by spaces, are what the automaton runs over, so a
phrase is found exactly where its words stand consecutively.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from seqspark.llm.common import LOWER_ASCII, process_cache

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Labels of the method's own: more precise notices and other families.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2": "apache-2.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "all rights reserved": "proprietary",
}
TAG_WORDS = "spdx license identifier"
# Families of license identifiers; a version or variant may follow after a hyphen.
_KNOWN = re.compile(r"(?:0bsd|afl|agpl|apache|apsl|artistic|blueoak|bsd|bsl|cc|cc0|cddl|cecill|cpl|ecl|epl|eupl|fdl|fsfap|gfdl|gpl|isc|lgpl|"
                    r"licenseref|lppl|mit|mpl|ms|mulanpsl|ncsa|odbl|ofl|openssl|osl|php|postgresql|psf|python|ruby|sgi|unicode|unlicense|upl|"
                    r"vim|w3c|wtfpl|x11|zlib|zpl)(?:-[a-z0-9.+-]+)?\+?")
_OPERATORS = {"or": 1, "and": 2, "with": 3}
_KEEP = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*")


def parse_expression(text: str) -> list[str] | None:
    """Shunting-yard: the longest leading license expression of ``text`` in postfix order.

    Operators by strength: with, and, or (letter case is free); with stands between one license and one
    exception.  Null when no operand stands first.  Anything after the expression (prose, comment closers)
    is left alone; an unclosed parenthesis is closed at the end.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next, at, depth, simple = True, 0, 0, False         # simple: the last token is a license without exception
    while m := _TOKEN.search(text, at):
        if text[at:m.start()].strip():
            break
        tok = m[0]
        low = tok.lower()
        if operand_next:
            if tok == "(" and not (stack and stack[-1] == "with"):
                stack.append("(")
                depth += 1
            elif tok in "()" or low in _OPERATORS:
                break
            else:
                out.append(low.rstrip("."))
                operand_next, simple = False, not (stack and stack[-1] == "with")
        elif tok == ")":
            if not depth:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
            depth, simple = depth - 1, False
        elif low in _OPERATORS and (low != "with" or simple):
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            break
        at = m.end()
    while operand_next and stack:                               # a dangling operator or parenthesis is prose
        operand_next = stack.pop() == "("
    out += [x for x in reversed(stack) if x != "("]
    return out or None


def evaluate(postfix: list[str]) -> tuple[str, list[str]]:
    """(expression with as few parentheses as needed, its licenses in order) of a postfix expression.

    The expression stays a tree, whose nodes are visited once; nothing is multiplied out.  A license with its
    exception is one license, ``<license> with <exception>``.
    """
    stack: list = []
    for tok in postfix:
        if tok not in _OPERATORS:
            stack.append(tok)
        elif len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            stack.append(f"{left} with {right}" if tok == "with" else (tok, left, right))
    words, licenses, todo = [], [], stack[:1]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            op, *sides = node
            left, right = (["(", x, ")"] if op == "and" and isinstance(x, tuple) and x[0] == "or" else [x] for x in sides)
            todo += reversed([*left, op, *right])
        else:
            words.append(node)
            if node not in ("(", ")", "and", "or"):
                licenses.append(node)
    return " ".join(words).replace("( ", "(").replace(" )", ")"), licenses


def license_label(name: str) -> str:
    """The license itself where its identifier belongs to a known family, else ``unknown``."""
    return name if _KNOWN.fullmatch(name.split(" with ")[0]) else "unknown"


def automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, MORE_PHRASES), (False, {TAG_WORDS: None})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (phrase.count(" ") + 1, base, label))
    found.make_automaton()
    return found


def scan_text(text: str | None, found) -> dict:
    """All matches of one text: word count, spans (label, first word, last word), tags, expressions."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(LOWER_ASCII).translate(_KEEP).split()
    line = f" {b' '.join(words).decode('latin-1')} "            # one character per byte
    n_base, starts, base, more, tags, spans = 0, [], set(), set(), 0, []
    at = passed = 0                                             # spaces before ``at``; ends do not go back
    for end, (size, is_base, label) in found.iter(line):
        passed += line.count(" ", at, end)
        at, first = end, passed - size
        if label is None:
            tags += 1
            continue
        spans.append((label, first, first + size - 1))
        if is_base:
            n_base += 1
            starts.append(first)
            base.add(label)
        else:
            more.add(label)
    expressions = []
    if tags:
        for m in _TAG.finditer(text):
            if postfix := parse_expression(m[1]):
                expression, licenses = evaluate(postfix)
                expressions.append(expression)
                more.update(map(license_label, licenses))
    return {"n_words": len(words), "n_base": n_base, "first_word": min(starts) if starts else None,
            "last_word": max(starts) if starts else None, "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | more)),
            "score": 1.0 - 0.5 ** (n_base + len(more) + len(expressions)), "spans": spans, "expressions": expressions}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word count, base places, labels, spans and tag expressions.

    No shuffle.  Null and empty texts have no words and no labels (empty strings, score 0); repeated
    rows give repeated results; other columns are ignored.
    """
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label string, first_word long, last_word long>>, "
              "expressions array<string>")

    def scan(batches):
        cache = process_cache("licenses")
        if "automaton" not in cache:
            cache["automaton"] = automaton()
        types = {"spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                              ("last_word", pa.int64())])),
                 "expressions": pa.list_(pa.string()), "base_labels": pa.string(), "labels": pa.string(),
                 "score": pa.float64()}
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", "expressions"]
        for b in batches:
            rows = [scan_text(t, cache["automaton"]) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[n] if n != "spans" else [dict(zip(("label", "first_word", "last_word"), s))
                                                         for s in r[n]] for r in rows], types.get(n, pa.int64()))
                    for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], ["doc_id", *names])

    return docs.selectExpr(f"cast(`{id_col}` as long)", f"`{text_col}`").mapInArrow(scan, schema)


def op5_license_scan(spark, sf_dir):
    from seqspark.llm.common import table
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans", "expressions")
