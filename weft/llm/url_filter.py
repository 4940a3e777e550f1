"""URL allow and block rules in a trie over reversed host labels and path segments.

The rule set is a parameter held by the driver and shipped with the function; its
size is checked against ``MAX_RULES``. A url walks the trie once: host labels from
the right, then path segments from the left, and the deepest rule on the walk wins
(more host labels first, then the longer path).

Defined results: a null url, or one without ``://``, has empty host and path and no
rule; without a rule the verdict is the filter's default. Every input row gives one
output row, repeated rows included, and other columns pass through untouched unless
they bear an output name, which the output replaces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    path: _Path | None = None  # rules of the host that ends here


@dataclass
class _Path:
    next: dict[str, _Path] = field(default_factory=dict)
    rule: Rule | None = None  # its path ends at this segment's slash
    part: list[Rule] = field(default_factory=list)  # paths that end within the next segment


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if not url:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class UrlTrie:
    def __init__(self, rules: list[Rule], default: str = "allow"):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie holds {MAX_RULES}")
        self.default, self.root = default, _Node()
        for r in rules:
            if r.action not in ("allow", "block") or (r.path and r.path[0] != "/"):
                raise ValueError(f"not a rule: {r}")
            self._add(r)

    def _add(self, r: Rule) -> None:
        node = self.root
        for label in reversed(r.host.split(".")):
            node = node.next.setdefault(label, _Node())
        at = node.path = node.path or _Path()
        *whole, part = r.path.split("/")
        for segment in whole:
            at = at.next.setdefault(segment, _Path())
        if part or not whole:
            at.part.append(r)
            at.part.sort(key=lambda x: -len(x.path))
        else:
            at.rule = r

    def find(self, host: str, path: str) -> Rule | None:
        node, found = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.path is not None and (rule := self._along(node.path, segments)):
                found = rule
        return found

    @staticmethod
    def _along(at: _Path, segments: list[str]) -> Rule | None:
        found = None
        last = len(segments) - 1
        for i, segment in enumerate(segments):
            found = next((r for r in at.part if segment.startswith(r.path.rpartition("/")[2])), found)
            if i == last or (at := at.next.get(segment)) is None:  # the last segment has no slash after it
                break
            found = at.rule or found
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = self.find(host, path)
        return host, path, rule and rule.name, rule.action if rule else self.default


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    trie = UrlTrie(rules, default)
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in df.columns if c.lower() not in added or c == url]
    ahead = df.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in added], F.col(f"`{url}`").cast("string").alias("__url"))
    schema = StructType([*ahead.schema.fields[:-1], *(StructField(c, StringType()) for c in added)])

    def run(batches):
        for batch in batches:
            made = [trie.judge(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([m[i] for m in made], pa.string()) for i in range(4))], names=[*batch.schema.names[:-1], *added])

    return ahead.mapInArrow(run, schema)
