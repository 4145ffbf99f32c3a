"""Names of a dictionary in texts: whole words, whatever the case, all types in one pass.

The names make one automaton, which every task builds once from a broadcast list. A dictionary of more than `most` names
is cut into parts by a hash, and each part is a pass of its own, so what is broadcast is bounded. Words are runs of
letters, digits and underscores; what stands between the words of a name does not count.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that are broadcast at once, and mentions that a worker holds before it hands them on.
MOST, AT_ONCE = 200_000, 5000
_WORD = re.compile(r"\w+")


class Names:
    """An automaton of (type, name) pairs; types of smaller number count before others."""

    def __init__(self, names: list[tuple[str, str]], order: list[str]):
        import ahocorasick

        found: dict[str, list[tuple[int, str, str]]] = {}
        for kind, name in names:
            words = _WORD.findall(name.lower())
            if words:
                found.setdefault(f" {' '.join(words)} ", []).append((order.index(kind) if kind in order else len(order), kind, name))
        self.automaton = ahocorasick.Automaton()
        for text, of in found.items():
            self.automaton.add_word(text, (len(text), sorted(of)))
        if found:
            self.automaton.make_automaton()

    def mentions(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """(priority, start, end, type, name) of every place of every name."""
        words = list(_WORD.finditer(text))
        if not len(self.automaton) or not words:
            return []
        line, at = [" "], [0]
        for w in words:  # at: where the space before a word stands in the line
            line += [w.group().lower(), " "]
            at.append(at[-1] + len(line[-2]) + 1)
        out = []
        for end, (size, of) in self.automaton.iter("".join(line)):
            first, after = bisect_left(at, end - size + 1), bisect_left(at, end)
            out += ((p, words[first].start(), words[after - 1].end(), kind, name) for p, kind, name in of)
        return out


def settled(found: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """What stays of overlapping mentions: the more important type, then the longer, then the earlier one; of names that
    differ in nothing else the smaller."""
    kept: list[tuple[int, int]] = []
    out = []
    for m in sorted(found, key=lambda m: (m[0], m[1] - m[2], m[1], m[3], m[4])):
        i = bisect_left(kept, (m[1], m[2]))
        if (i == 0 or kept[i - 1][1] <= m[1]) and (i == len(kept) or kept[i][0] >= m[2]):
            insort(kept, (m[1], m[2]))
            out.append(m)
    return out


_own: dict[str, Names] = {}


def mentions(docs: DataFrame, names: DataFrame, order: list[str], key: str = "doc_id", text: str = "text", settle: bool = True, most: int = MOST) -> DataFrame:
    """key, start, end (code points), type, name, entity_text of the names (type, name) in each text.

    settle keeps no two that overlap, across all types of the dictionary (`order` has the more important first, types
    that it lacks come last); without it every mention stays. A null text or name has none. Rows of one key each have
    their own mentions."""
    spark = docs.sparkSession
    own = names.select("type", "name").where("name IS NOT NULL AND type IS NOT NULL").distinct()
    parts = max(1, -(-own.count() // most))
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, row long, priority int, start int, end int, type string, name string, entity_text string"
    columns = [key, "row", "priority", "start", "end", "type", "name", "entity_text"]
    rows, out = docs.select(key, F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")), None
    for part in range(parts):
        some = own if parts == 1 else own.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([(r["type"], r["name"]) for r in some.collect()])  # at most about `most` names

        def find(batches: Iterator[pd.DataFrame], sent=sent, name=uuid.uuid4().hex, alone=parts == 1) -> Iterator[pd.DataFrame]:
            if name not in _own:  # a worker keeps its last automaton
                _own.clear()
                _own[name] = Names(sent.value, order)
            dictionary = _own[name]
            for b in batches:
                out = []
                for k, row, t in zip(b[key], b["row"], b["text"], strict=True):
                    if t is not None:
                        found = dictionary.mentions(t)
                        for m in settled(found) if settle and alone else found:
                            out.append((k, row, *m, t[m[1] : m[2]]))
                            if len(out) == AT_ONCE:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
                yield pd.DataFrame(out, columns=columns)

        found = rows.mapInPandas(find, schema)
        out = found if out is None else out.union(found)
    if settle and parts > 1:  # mentions of all parts meet, without the texts

        def keep(b: pd.DataFrame) -> pd.DataFrame:
            stay = set(settled(list(b[["priority", "start", "end", "type", "name"]].itertuples(index=False, name=None))))
            return b[[m in stay for m in b[["priority", "start", "end", "type", "name"]].itertuples(index=False, name=None)]]

        out = out.groupBy("row").applyInPandas(keep, schema)
    return out.select(key, "start", "end", "type", "name", "entity_text")
