"""Secret scans over a trigram inverted index.

Each rule's regex is parsed and turned into a Boolean query over trigrams that any match must contain.
A batch of documents is one index segment: postings of the trigrams that the queries name, over the
lower-cased UTF-8 bytes.  AND intersects postings, OR unites them; the candidates are verified with the
rule's regex on the whole text.  A rule whose query is empty (no mandatory trigram) scans every text.

Edge cases: null text is empty and has no spans; null ``doc_id`` and repeated rows are kept as they are;
an empty table gives no rows; other columns are ignored.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedimark.llm.common import doc_rows, slices, text_bytes

try:  # the parser of re moved into the package in 3.11
    from re import _constants as sre, _parser as parser
except ImportError:
    import sre_constants as sre
    import sre_parse as parser

#: Exact strings kept for a node before only its query remains.
MOST_EXACT = 64
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that the group must have
    group: int = 0


# The base rules first, then published formats of well-known tokens and keys.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

#: A query: None holds for every text; else ("and" | "or", parts) or a trigram as bytes.
Query = object


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> Query:
    """Holds for texts with at least one of the strings, as far as trigrams can tell."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _lower(code: int) -> bytes | None:
    """The lower-cased byte of an ASCII code point; None for others."""
    return chr(code).lower().encode() if code < 128 else None


def _node(op, value) -> tuple[set[bytes] | None, Query]:
    """(all strings that the node can match, or None if too many; a query its matches fulfil)."""
    if op is sre.LITERAL:
        c = _lower(value)
        return ({c}, None) if c else (None, None)
    if op is sre.IN:
        chars: set[bytes] = set()
        for kind, x in value:
            codes = [x] if kind is sre.LITERAL else range(x[0], x[1] + 1) if kind is sre.RANGE and x[1] - x[0] < 64 else [128]
            for code in codes:
                if (c := _lower(code)) is None:
                    return None, None
                chars.add(c)
        return (chars, None) if len(chars) <= 10 else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(e is not None for e, _ in found) and len(union := set().union(*(e for e, _ in found))) <= MOST_EXACT:
            return union, None
        return None, _any([_all([q, _of_strings(e) if e is not None else None]) for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        exact, query = _sequence(body)
        if low == 0:
            return (exact | {b""}, None) if high == 1 and exact is not None else (None, None)
        if exact is not None and high == low and len(exact) ** low <= MOST_EXACT:
            return {b"".join(x) for x in product(exact, repeat=low)}, None
        return None, _all([query, _of_strings(exact) if exact is not None else None])
    if op is sre.AT:
        return {b""}, None
    return None, None


def _sequence(nodes) -> tuple[set[bytes] | None, Query]:
    """As ``_node`` for a concatenation: runs of exact nodes are joined, then cut into trigrams."""
    queries, run, whole = [], {b""}, True
    for op, value in nodes:
        exact, query = _node(op, value)
        queries.append(query)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        queries.append(_of_strings(run))
        whole = False
        run = exact if exact is not None else {b""}
    if whole and all(q is None for q in queries):
        return run, None
    return None, _all([*queries, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex; None if it has no mandatory trigram."""
    exact, query = _sequence(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings (ascending document numbers) of the wanted trigrams over one batch of texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: list[bytes]):
        self.n = len(offsets) - 1
        codes = {int.from_bytes(t, "big"): i for i, t in enumerate(wanted)}
        mark = np.zeros(1 << 24, np.bool_)
        mark[list(codes)] = True
        numbers = np.zeros(1 << 24, np.int32)
        numbers[list(codes)] = list(codes.values())
        hits: list[np.ndarray] = []
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        for first, last in slices(offsets, 1 << 20):
            part = fold[raw[offsets[first] : offsets[last]]].astype(np.uint32)
            if len(part) < 3:
                continue
            code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            at = np.flatnonzero(mark[code])
            doc = np.searchsorted(offsets, at + offsets[first], "right") - 1
            inside = at + offsets[first] + 3 <= offsets[doc + 1]
            hits.append(np.unique(numbers[code[at[inside]]].astype(np.int64) << 32 | doc[inside]))
        pairs = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        kind, doc = pairs >> 32, pairs & 0xFFFFFFFF
        self.postings = {t: doc[kind == i] for i, t in enumerate(wanted)}

    def find(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


def find_spans(texts: list[str], raw: np.ndarray, offsets: np.ndarray, rules=RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every secret of each text, in that order."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    segment = Segment(raw, offsets, wanted)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        search = re.compile(rule.pattern).finditer
        for d in segment.find(query).tolist():
            out[d] += [(m.start(), k, m.end()) for m in search(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    for spans in out:
        spans.sort()
    return out


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    kinds = [r.kind for r in rules]

    def scan(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            raw, offsets = text_bytes(batch.column("text"))
            found = find_spans(texts, raw, offsets, rules)
            show = [[(kinds[k], f"{kinds[k]}:{a}:{b}") for a, k, b in spans] for spans in found]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(k == kind for k, _ in spans) for spans in show], pa.int64()) for kind in BASE]
            columns.append(pa.array([hashlib.sha256(",".join(s for k, s in spans if k in BASE).encode()).hexdigest() for spans in show]))
            columns.append(pa.array([",".join(s for _, s in spans) for spans in show], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return doc_rows(docs).mapInArrow(scan, RESULT)


# The rules once more in RE2's spelling, where a letter in either case is a class of two.
_RE2 = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
}


def scan_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same by definition: every rule over every whole text; a match starts where the gaps and matches before it end."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = _RE2.get(rule.kind, rule.pattern).replace("'", "''")
        kept = f"length(regexp_extract(m, '{pattern}', {rule.group}))" if rule.group else "length(m)"
        parts.append(
            f"select doc_id, {k} as k, '{rule.kind}' as kind, p, p + length(m) as q from (select doc_id, m, cast(coalesce(sum(length(gap) + length(m)) over w, 0) + length(gap) as bigint) as p "
            f"from (select doc_id, unnest(regexp_extract_all(t, '{pattern}')) as m, unnest(regexp_split_to_array(t, '{pattern}')) as gap, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) as i from d) "
            f"window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)) where m is not null and {kept} >= {rule.least}"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)
    span = "kind || ':' || p || ':' || q"
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), s as (" + " union all ".join(parts) + ") "
        f"select d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' order by p, k) filter (where kind in ({base})), '')) as base_sha256, "
        f"coalesce(string_agg({span}, ',' order by p, k), '') as spans from d left join s using (doc_id) group by d.doc_id"
    )
