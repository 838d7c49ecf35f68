"""URL filters: many glob rules simulated at once on each URL.

The rules are packed into one long bit string, a bit per pattern position,
that spreads over several 64-bit words. One Shift-And step per character moves
the states of all rules together; a batch of URLs advances side by side.

Globs: `*` any characters but `/`, `**` any characters, `?` one character but
`/`, all else literally. They match a whole canonical URL: a dot, the host in
lower case, the path. The leading dot lets `*.org/**` fit org and its
subdomains.
"""

import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Rule = namedtuple("Rule", "verdict glob label weight")

# fixed values: site rules as (verdict, host, path)
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# hosts and paths to leave out where no site rule speaks
BLOCKED_GLOBS = (
    "*.adult**",
    "*.casino**",
    "*.xxx**",
    "*.ads.**",
    "**/login**",
    "**/wp-admin/**",
    "**/cart/**",
)
_ALL = (1 << 64) - 1


def site_rule(verdict, host, path):
    """A rule for a host, its subdomains, and paths with a given start."""
    if re.search(r"[*?]", host + path):
        raise ValueError("site rules hold no wildcards")
    return Rule(verdict, f"*.{host}{path}**", f"{host}{path}", len(host + path))


class Automaton:
    """All globs as multiword masks: what moves on, what stays, what accepts."""

    def __init__(self, globs):
        moves, stays, first, last, bit = {}, {}, [], [], 0
        for glob in globs:
            first.append(bit)
            for token in re.findall(rb"\*\*+|\*|\?|[^*?]", glob.encode(), re.S):
                if token.startswith(b"*"):
                    stays[bit] = "any" if len(token) > 1 or stays.get(bit) == "any" else "part"
                else:
                    bit += 1
                    moves[bit] = token[0] if token != b"?" else "lead"
                    if token == b"?":
                        stays[bit] = "rest"  # the other bytes of the character
            last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.move = self._masks(moves)
        self.stay = self._masks(stays)
        self.start = self._bits(first)
        self.last = [(b // 64, np.uint64(b % 64)) for b in last]

    def _bits(self, bits):
        total = sum(1 << b for b in bits)
        return np.array([(total >> (64 * w)) & _ALL for w in range(self.words)], np.uint64)

    def _masks(self, on):
        table = np.zeros((256, self.words), np.uint64)
        for c in range(256):
            kinds = {c, "any", "rest" if 0x80 <= c < 0xC0 else "lead" if c != ord("/") else None}
            kinds |= {"part"} if c != ord("/") else set()
            table[c] = self._bits(b for b, what in on.items() if what in kinds)
        return table

    def matches(self, urls):
        """One row per URL, one column per glob."""
        length = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-length, kind="stable")
        state = np.tile(self.start, (len(urls), 1))
        data = np.frombuffer(b"".join(urls), np.uint8)
        begin = (np.cumsum(length) - length)[order]
        alive = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        for step, n in enumerate(alive):
            char = data[begin[:n] + step]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.move[char]) | (now & self.stay[char])
        found = np.zeros((len(urls), len(self.last)), bool)
        for i, (word, bit) in enumerate(self.last):
            found[order, i] = (state[:, word] >> bit) & np.uint64(1) == 1
        return found


def _judged(batches, rules, blocked, schema):
    # of the rules that fit, the heaviest speaks, then the first by label
    rules = sorted(rules, key=lambda r: (-r.weight, r.label))
    automaton = Automaton([r.glob for r in rules] + list(blocked))
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("host", "path")]
        urls = [f".{h}{p}".encode() for h, p in zip(*columns)]
        found = automaton.matches(urls)
        site = found[:, : len(rules)]
        which = np.where(site.any(axis=1), site.argmax(axis=1), -1) if rules else np.full(len(urls), -1)
        other = found[:, len(rules) :].any(axis=1)
        label = [rules[w].label if w >= 0 else None for w in which]
        verdict = [
            rules[w].verdict if w >= 0 else "block" if o or not h else "allow"
            for w, o, h in zip(which, other, columns[0])
        ]
        more = {"rule": pa.array(label, pa.string()), "verdict": pa.array(verdict, pa.string())}
        yield pa.RecordBatch.from_arrays([more.get(f.name, batch[f.name] if f.name in batch.schema.names else None) for f in schema], schema=schema)


def judge_urls(pages: DataFrame, id_col="page_id", url_col="url", rules=None, blocked=BLOCKED_GLOBS, carry=()) -> DataFrame:
    """Host, path, the rule that speaks and the verdict for each URL.

    `rules` are `Rule`s (default: the site rules); of those that fit, the one
    with the greatest weight wins, ties go to the smaller label. Where none
    fits, a URL is blocked if a glob of `blocked` matches or it has no host,
    else allowed. Returns id, rest (a struct of the columns named in `carry`),
    host, path, rule, verdict.

    Defined cases: a null URL, or one without `://`, has an empty host and
    path and is blocked; only A to Z are lower-cased; very long URLs are read
    whole; repeated rows are judged one by one; an empty table gives an empty
    result; columns not named are ignored, whatever they are called.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rules = [site_rule(*r) for r in SITE_RULES] if rules is None else list(rules)
    url = F.col(url_col).cast("string")
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("rest"),
        F.translate(F.regexp_extract(after, "^[^/?#]*", 0), upper, upper.lower()).alias("host"),
        F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    out = rows.withColumns({"rule": F.lit("").cast("string"), "verdict": F.lit("")}).schema
    for field in out.fields:
        field.nullable = True
    schema = to_arrow_schema(out)
    return rows.mapInArrow(lambda batches: _judged(batches, rules, blocked, schema), out)


def op6_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(SITE_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_GLOBS = "|".join(
    re.sub(r"\*\*|\*|\.", lambda m: {"**": ".*", "*": "[^/]*", ".": "\\."}[m[0]], g) for g in BLOCKED_GLOBS
)
SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in _BY_LENGTH)}
            WHEN host = '' OR regexp_full_match('.' || host || path, '{_GLOBS}', 's') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
