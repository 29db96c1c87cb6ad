"""Source files that do not parse: minimum-cost repair by error-correcting chart parsing."""

from __future__ import annotations

import ast
import heapq
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshline.llm import grammars, lexers
from meshline.tables import current_rows

CAP = 4
WINDOW = 48
MEMO = 400_000
NESTING = 10_000_000
FILES_PER_TASK = 20_000
# Extensions of the languages with a grammar, and interpreter names of files without extension.
EXTENSIONS = {"py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "rs": "rust", "json": "json"}
INTERPRETERS = {"python": "python", "node": "javascript", "nodejs": "javascript", "deno": "typescript", "bun": "typescript", "ts-node": "typescript"}
# How codes, and messages without a code, say that a file could not be parsed.
PARSE_CODE = r"^\s*(e[_-])?(syntax|parse)[_ -]?(error|fail(ed|ure)?)?\s*$"
PARSE_MESSAGE = r"(?i)syntax error|unexpected (token|end)|unterminated|cannot parse|parser gave up|could not be parsed|parse error"


def language_of(path: str | None, content: str | None) -> str | None:
    """Language by the path's extension in any case, by the interpreter line if there is none; null for others."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    if "." in name.lstrip("."):
        return EXTENSIONS.get(name.rsplit(".", 1)[-1])
    m = re.match(r"#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z-]+)", content or "")
    return INTERPRETERS.get(m.group(1).lower()) if m else None


@dataclass
class Group:
    """A bracketed stretch: its bracket, the sequence inside, and where it starts in the text."""

    bracket: str
    seq: int


@dataclass
class Verdict:
    cost: int
    at: int
    reason: str


class ChartParser:
    """Earley charts over bracket groups, with insertions, deletions and substitutions at cost 1 each.

    A text is lexed, its brackets are matched, and each group's content becomes
    a sequence of token kinds and inner groups. Sequences are interned: equal
    ones, wherever they occur, share one chart. A sequence is first parsed at
    cost 0; rules are predicted only where the next token can begin them, which
    keeps charts near linear. Where that fails, the repair chart relaxes item
    costs in order until the cheapest complete parse, or a cost above CAP, is
    reached. It runs over the stretch between the last list boundary of the
    valid prefix and the first boundary from which the rest is valid, with edits
    up to WINDOW tokens from the failure; merge markers are tokens like others.
    Text whose tokens need more than CAP edits whatever stands around them, as
    that of another language does, gets CAP + 1 from those places alone.
    Brackets without partner are repaired first, by the interval chart of the
    bracket language.
    """

    def __init__(self, lang: str):
        self.lang = lang
        self.g = grammars.Grammar(lang, lexers.KEYWORDS[lang])
        self.seqs: list[tuple] = []
        self.seq_ids: dict[tuple, int] = {}
        self.groups: list[Group] = []
        self.group_ids: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.costs: dict[tuple[int, int], int] = {}
        self.asked: dict[int, set[int]] = {}

    def _intern(self, elems: list) -> int:
        key = tuple(elems)
        k = self.seq_ids.get(key)
        if k is None:
            k = self.seq_ids[key] = len(self.seqs)
            self.seqs.append(key)
        return k

    def _group(self, bracket: str, elems: list) -> int:
        key = (bracket, self._intern(elems))
        k = self.group_ids.get(key)
        if k is None:
            k = self.group_ids[key] = len(self.groups)
            self.groups.append(Group(*key))
        return k

    def _matches(self, elem, sym) -> bool:
        what = elem[0]
        if isinstance(sym, tuple):
            if not isinstance(what, int):
                return False
            grp = self.groups[what]
            if grp.bracket != sym[0]:
                return False
            self.asked.setdefault(what, set()).add(sym[1])
            return self.valid(grp.seq, sym[1])
        if sym == "ANYWORD":
            return isinstance(what, str) and what not in ("ERR", "CONFLICT")
        return what == sym

    def _guard(self, sym: str, seq: tuple, i: int) -> bool:
        if sym == "EOS":
            return i == len(seq) or seq[i][1] or self.lang != "go" and i > 0 and isinstance(seq[i - 1][0], int) and self.groups[seq[i - 1][0]].bracket == "{"
        if i == len(seq):
            return True
        head = self._kind(seq[i])
        return head != "{" and (sym == "STARTSNOBRACE" or head not in ("function", "class"))

    def _kind(self, elem) -> str:
        return self.groups[elem[0]].bracket if isinstance(elem[0], int) else elem[0]

    def chart(self, seq: tuple, start: int, lists: bool = False) -> tuple[bool, int, int]:
        """Whether ``seq`` derives ``start``; the token where the chart ended; the last boundary of a list at the front."""
        g, n = self.g, len(seq)
        nxt, lhs = g.next, g.lhs
        kinds = [self._kind(e) for e in seq] + [None]
        sets: list[set] = [set() for _ in range(n + 1)]
        wait: list[dict] = [{} for _ in range(n + 1)]
        sets[0].update((s, 0) for s in g.predicted(start, kinds[0]))
        wait[0][start] = []
        boundary, ok = 0, False
        for i in range(n + 1):
            here, waiting, ended = sets[i], wait[i], {}
            if not here:
                return False, i - 1, boundary
            work = list(here)
            while work:
                s, o = work.pop()
                sym = nxt[s]
                if sym is None:
                    left = lhs[s]
                    if o == i:
                        ended[left] = True
                    if o == 0 and left in g.lists and i < n:
                        boundary = i
                    if o == 0 and left == start and i == n:
                        ok = True
                    for s2, o2 in list(wait[o].get(left, ())):
                        item = (s2 + 1, o2)
                        if item not in here:
                            here.add(item)
                            work.append(item)
                elif isinstance(sym, int):
                    w = waiting.get(sym)
                    if w is None:
                        waiting[sym] = [(s, o)]
                        for p in g.predicted(sym, kinds[i]):
                            item = (p, i)
                            if item not in here:
                                here.add(item)
                                work.append(item)
                    else:
                        w.append((s, o))
                        if i == 0 and sym == start and not w[:-1]:
                            pass
                    if sym in ended:
                        item = (s + 1, o)
                        if item not in here:
                            here.add(item)
                            work.append(item)
                elif sym in grammars.GUARDS:
                    if self._guard(sym, seq, i):
                        item = (s + 1, o)
                        if item not in here:
                            here.add(item)
                            work.append(item)
                elif i < n and self._matches(seq[i], sym):
                    sets[i + 1].add((s + 1, o))
        return ok, n, boundary

    def valid(self, seq_id: int, start: int) -> bool:
        key = (seq_id, start)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self.chart(self.seqs[seq_id], start)[0]
        return got

    def _weight(self, elem) -> int:
        """Tokens that go when an element is deleted: one, or a group's brackets and all inside, counted up to CAP + 1."""
        if not isinstance(elem[0], int):
            return 1
        total, todo = 0, [elem]
        while todo and total <= CAP:
            e = todo.pop()
            total += 2 if isinstance(e[0], int) else 1
            if isinstance(e[0], int):
                todo += self.seqs[self.groups[e[0]].seq][: CAP + 1]
        return min(total, CAP + 1)

    def _scan_cost(self, elem, sym) -> int:
        """Cost of reading ``elem`` as ``sym``: 0, the group's own repair, or a substitution."""
        if isinstance(sym, tuple) and isinstance(elem[0], int):
            grp = self.groups[elem[0]]
            if grp.bracket != sym[0]:
                return 2 if not self.seqs[grp.seq] else CAP + 1
            if self.valid(grp.seq, sym[1]):
                return 0
            return self.repair(grp.seq, sym[1])[0] if sym[1] in self.asked.get(elem[0], ()) else CAP + 1
        if self._matches(elem, sym):
            return 0
        return 1 if not isinstance(elem[0], int) else CAP + 1

    def _needed(self, seq: tuple, start: int) -> tuple[list[int], list[int]]:
        """Edits that the tokens before, and from, each place need at least, whatever stands around them.

        Two kinds that no derivation puts side by side need an edit at one of
        them or between them, and a kind that the grammar lacks needs one itself;
        of such places as share no token each needs its own edit.
        """
        beside, words = self.g.adjacent[start], ("ID", "NUM", "STR", "LIFE", "(", "[", "{", "INDENT")
        kinds = [self._kind(e) for e in seq]
        alone = [k in (lexers.BAD, lexers.CONFLICT) for k in kinds]
        word = [not k in words for k in kinds]

        def apart(i: int) -> bool:
            x, y = kinds[i], kinds[i + 1]
            if (x, y) in beside:
                return False
            return not (word[i] and ("ANYWORD", y) in beside or word[i + 1] and (x, "ANYWORD") in beside or word[i] and word[i + 1] and ("ANYWORD", "ANYWORD") in beside)

        n = len(seq)
        before, after, used = [0] * (n + 1), [0] * (n + 1), -1
        for i in range(n):
            hit = alone[i] or i - 1 > used and apart(i - 1)
            before[i + 1] = before[i] + hit
            used = i if hit else used
        used = n
        for i in range(n - 1, -1, -1):
            hit = alone[i] or i + 1 < used and apart(i)
            after[i] = after[i + 1] + hit
            used = i if hit else used
        return before, after

    def repair(self, seq_id: int, start: int) -> tuple[int, int]:
        """(minimum edit cost, token of the first edit), the cost limited to CAP + 1."""
        seq = self.seqs[seq_id]
        ok, fail, low = self.chart(seq, start)
        if ok:
            return 0, -1
        key = (seq_id, start)
        if key in self.costs:
            return self.costs[key], fail
        self.costs[key] = CAP + 1
        if self._needed(seq, start)[1][0] <= CAP:
            high, kinds = len(seq), [self._kind(e) for e in seq]
            bad = max((i for i in range(max(0, fail), min(len(seq), fail + WINDOW)) if kinds[i] in (lexers.BAD, lexers.CONFLICT)), default=max(0, fail))
            for r in range(bad + 1, min(len(seq), fail + WINDOW)):
                if low and self.chart(seq[r:], start)[0]:
                    high = r
                    break
            part, off = (seq[low:high], low) if low else (seq, 0)
            self.costs[key] = self._cheapest(part, start, max(0, fail - off - WINDOW), bad - off + WINDOW)
        return self.costs[key], fail

    def _cheapest(self, seq: tuple, start: int, lo: int, hi: int) -> int:
        """Cost of the cheapest parse with edits at the places from ``lo`` to ``hi``, by relaxing items in order of cost.

        An item is dropped if its cost and the edits that the tokens before and
        after it need come above CAP.
        """
        g, n = self.g, len(seq)
        nxt, lhs = g.next, g.lhs
        kinds = [self._kind(e) for e in seq] + [None]
        before, after = self._needed(seq, start)
        best: dict[tuple[int, int, int], int] = {}
        wait: list[dict] = [{} for _ in range(n + 1)]
        ended: list[dict] = [{} for _ in range(n + 1)]
        heap: list = []

        def push(i: int, s: int, o: int, c: int) -> None:
            if c + before[o] + after[i] <= CAP and c < best.get((i, s, o), CAP + 1):
                best[i, s, o] = c
                heapq.heappush(heap, (c, i, s, o))

        for s in g.starts[start]:
            push(0, s, 0, 0)
        while heap:
            c, i, s, o = heapq.heappop(heap)
            if best[i, s, o] < c:
                continue
            if len(best) > MEMO:
                return CAP + 1
            sym = nxt[s]
            if sym is None:
                left = lhs[s]
                if o == 0 and left == start:
                    if i == n:
                        return c
                    if lo <= i <= hi:  # what is left over at the end is deleted
                        push(i + 1, s, o, c + self._weight(seq[i]))
                span = ended[o].setdefault(left, {})
                if c < span.get(i, CAP + 1):
                    span[i] = c
                    for (s2, o2), c2 in list(wait[o].get(left, {}).items()):
                        push(i, s2 + 1, o2, c2 + c)
                continue
            edits = lo <= i <= hi
            if i < n and edits:
                push(i + 1, s, o, c + self._weight(seq[i]))
            if isinstance(sym, int):
                w = wait[i].setdefault(sym, {})
                if c < w.get((s, o), CAP + 1):
                    fresh = not w
                    w[s, o] = c
                    if fresh:
                        for p in g.starts[sym] if edits else g.predicted(sym, kinds[i]):
                            push(i, p, i, 0)
                    for j, cost in ended[i].get(sym, {}).items():
                        push(j, s + 1, o, c + cost)
            elif sym in grammars.GUARDS:
                if self._guard(sym, seq, i):
                    push(i, s + 1, o, c)
                elif edits:
                    push(i, s + 1, o, c + 1)
            else:
                if edits:
                    push(i, s + 1, o, c + 1)
                if i < n:
                    cost = self._scan_cost(seq[i], sym)
                    if not cost or edits:
                        push(i + 1, s + 1, o, c + cost)
        return CAP + 1

    def _trim(self) -> None:
        if len(self.seqs) > MEMO:
            self.seqs, self.seq_ids, self.groups, self.group_ids = [], {}, [], {}
            self.known, self.costs, self.asked = {}, {}, {}

    def check(self, text: str) -> Verdict:
        """The repair cost of a whole text with the place and kind of its first edit; cost 0 means that it parses."""
        self._trim()
        toks = lexers.lex(text, self.lang)
        marker = next((t.at for t in toks if t.kind == lexers.CONFLICT), None)
        residue, tree = self._match(toks)
        if residue:
            cost = dyck_cost([t.kind for t in toks if t.kind in lexers.OPEN or t.kind in lexers.CLOSE])  # with the partners that cross the residue
            at = residue[0].at
            return Verdict(cost, at, "conflict" if marker is not None else self._cut_or_local(text, residue))
        elems, places = tree
        root = self._intern(elems)
        start = self.g.ids["Start"]
        if self.valid(root, start):
            return Verdict(0, -1, "")
        cost, fail = self.repair(root, start)
        at = places[min(fail, len(places) - 1)] if places else 0
        if marker is not None:
            return Verdict(cost, marker, "conflict")
        if cost > CAP:
            return Verdict(cost, at, "mismatch")
        return Verdict(cost, at, "truncation" if fail >= len(elems) - 1 and not text.endswith("\n") else "local")

    @staticmethod
    def _cut_or_local(text: str, residue: list[lexers.Token]) -> str:
        """Open brackets alone are a truncation unless a line at the left margin follows the first of them."""
        if any(t.kind in lexers.CLOSE for t in residue):
            return "local"
        after = text[residue[0].at :].split("\n", 1)
        return "local" if len(after) > 1 and re.search(r"(?m)^[^\s})\]]", after[1]) else "truncation"

    def _match(self, toks: list[lexers.Token]) -> tuple[list[lexers.Token], tuple[list, list]]:
        """Brackets that find no partner, and the sequence of the whole text."""
        stack: list[tuple] = [("", None, [], [])]
        loose: list[lexers.Token] = []
        for t in toks:
            if t.kind in lexers.OPEN:
                stack.append((t.kind, t, [], []))
            elif t.kind in lexers.CLOSE:
                if stack[-1][0] == lexers.CLOSE[t.kind]:
                    bracket, opened, elems, _ = stack.pop()
                    stack[-1][2].append((self._group(bracket, elems), opened.nl))
                    stack[-1][3].append(opened.at)
                else:
                    loose.append(t)
            else:
                stack[-1][2].append((t.kind, t.nl))
                stack[-1][3].append(t.at)
        loose += [s[1] for s in stack[1:]]
        return sorted(loose, key=lambda t: t.at), (stack[0][2], stack[0][3])


def dyck_cost(kinds: list[str]) -> int:
    """Fewest insertions, deletions and substitutions that balance a sequence of brackets of any length.

    Neighbours that match are taken out first, which changes no cost. Closing
    brackets before opening ones pair among themselves. For the rest, row i of
    the interval chart has the cost of every stretch from i: its first bracket
    goes, or pairs with one at m. Only pairs that are cheaper than what is known
    of their stretch are followed, since costs of adjacent stretches add up.
    Rows are kept as steps of -1, 0 or 1, a byte each.
    """
    left: list[str] = []
    for k in kinds:
        if left and lexers.OPEN.get(left[-1]) == k:
            left.pop()
        else:
            left.append(k)
    n, first = len(left), next((i for i, k in enumerate(left) if k in lexers.OPEN), len(left))
    if not any(k in lexers.CLOSE for k in left[first:]):
        return (first + 1) // 2 + (n - first + 1) // 2
    closing = np.array([k in lexers.CLOSE for k in left])
    swaps = {k: np.array([b == lexers.OPEN.get(k) for b in left]) for k in set(left)}
    swaps = {k: np.where(same, 0, 1 if k in lexers.OPEN else 2 - closing).astype(np.int32) for k, same in swaps.items()}
    steps: list = [np.zeros(0, np.int8)] * (n + 1)
    below = np.zeros(1, np.int32)
    for i in range(n - 1, -1, -1):
        row = np.concatenate(([0], 1 + below)).astype(np.int32)
        inner = below[:-1] + swaps[left[i]][i + 1 :]
        for m in np.flatnonzero(inner < row[2:]):
            if inner[m] < row[m + 2]:
                row[m + 2 :] = np.minimum(row[m + 2 :], inner[m] + np.concatenate(([0], np.cumsum(steps[i + m + 2], dtype=np.int32))))
        steps[i], below = np.diff(row).astype(np.int8), row
    return int(below[n])


@lru_cache(maxsize=16)
def parser(lang: str) -> ChartParser:
    return ChartParser(lang)


def _exact(text: str, lang: str) -> bool:
    """Whether the language's own parser, where there is one here, takes a text that the chart would repair."""
    try:
        if lang == "python":
            ast.parse(text.removeprefix("\ufeff"))
            return True
        if lang == "json":
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
    except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
        pass
    return False


def verdict(path: str | None, text: str | None) -> Verdict | None:
    """Repair of one file; null where there is no text or no grammar for the path's language.

    The chart's cost decides. Python and strict JSON, which have an exact parser
    at hand, are given the benefit of it where the chart finds a cost.
    """
    lang = language_of(path, text)
    if text is None or lang is None:
        return None
    if sys.getrecursionlimit() < NESTING:
        sys.setrecursionlimit(NESTING)
    got = parser(lang).check(text.replace("\r\n", "\n").replace("\r", "\n"))
    if got.cost and _exact(text, lang):
        return Verdict(0, -1, "")
    return got


RESULT = "path string, repo string, lang string, cost int, at int, reason string, has_text boolean"


def repairs(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(path, repo, lang, cost, at, reason, has_text): every current file with the cost of its cheapest syntax repair.

    ``cost`` is 0 for valid text and null where the language has no grammar;
    ``reason`` is conflict, truncation, mismatch (cost above CAP: another
    language) or local. A file without content has cost 1 and reason
    ``reported`` if a diagnostic made for its current hash says that it could
    not be parsed, else a null cost. An empty text is valid where the language
    allows it. Calls between Python functions take no machine stack, so depth of
    nesting is bound by memory alone.
    """
    cur = current_rows(files, "path", ["generation", "repo", "hash", "content"])
    code, message = F.lower("code"), F.coalesce("message", F.lit(""))
    says = F.when(F.col("code").isNotNull(), code.rlike(PARSE_CODE)).otherwise(message.rlike(PARSE_MESSAGE))
    told = diagnostics.where(says & F.col("file").isNotNull() & F.col("hash").isNotNull()).select(F.col("file").alias("path"), "hash").distinct()
    empty = cur.where("content is null").join(told.withColumn("said", F.lit(True)), ["path", "hash"], "left")
    reported = empty.select("path", "repo", F.lit(None).cast("string").alias("lang"), F.when(F.col("said"), 1).cast("int").alias("cost"), F.lit(-1).alias("at"), F.when(F.col("said"), F.lit("reported")).alias("reason"), F.lit(False).alias("has_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, r, c in zip(b["path"], b["repo"], b["content"], strict=True):
                v = verdict(p, c)
                rows.append((p, r, language_of(p, c), v and v.cost, v and v.at, v and v.reason, True))
            out = pd.DataFrame(rows, columns=["path", "repo", "lang", "cost", "at", "reason", "has_text"])
            yield out.astype({"cost": "Int32", "at": "Int32"})

    # parsing is bound by the CPU, so tasks go by files and cores, not by bytes
    tasks = max(3 * files.sparkSession.sparkContext.defaultParallelism, files.count() // FILES_PER_TASK)
    parsed = cur.where("content is not null").select("path", "repo", "content").repartition(tasks, "path").mapInPandas(run, RESULT)
    return parsed.unionByName(reported)


def broken(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    return repairs(files, diagnostics).where("cost > 0").select("path")


def rates(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(repo, lang, reason, n_files, n_broken, rate) per repository and language, and per kind of trouble."""
    told = repairs(files, diagnostics).where("cost is not null")
    per = told.groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.sum(F.when(F.col("cost") > 0, 1).otherwise(0)).alias("n_broken"))
    kinds = ["conflict", "truncation", "mismatch", "local", "reported"]
    by = told.where("cost > 0").groupBy("repo", "lang").agg(*[F.count_if(F.col("reason") == k).alias(f"n_{k}") for k in kinds])
    out = per.alias("a").join(by.alias("b"), F.col("a.repo").eqNullSafe(F.col("b.repo")) & F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    return out.select("a.repo", "a.lang", "n_files", "n_broken", (F.col("n_broken") / F.col("n_files")).alias("rate"), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds])
