"""URL rules, then a weighted vocabulary of strict and soft terms.

A url that no host and path rule decides is searched once by an Aho-Corasick
automaton over all terms, A-Z lower-cased and escapes of ASCII characters (%61)
decoded once. A hit counts only at word boundaries (no ASCII letter or digit on either
side); where hits overlap, the longest counts and the others do not. One strict term
blocks; soft terms block if FEWEST_SOFT or more are there, each counted once, and their
weights add up to SOFT_LIMIT or more, so that no soft term blocks by itself.

The vocabulary is a parameter, a table (term, kind, weight); the one below has common
words of the categories that public block lists keep: adult, gambling, pharmacy, piracy,
credit, advertising.

Cases: null or no '://' means empty host and path and no rule; the vocabulary sees
the whole url, a null url nothing; ties between rules of one length go to the first;
repeated rows give repeated results; further columns are ignored; an empty table
gives an empty result; a very long url is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import prepare

#: (verdict, host and path prefix); a rule fits its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Terms of which one blocks.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "milf", "camgirl", "camgirls", "escort", "escorts",
    "casino", "casinos", "sportsbook",
    "viagra", "cialis", "levitra",
    "warez", "keygen", "keygens",
)
#: Terms that are harmless alone, with their weights: 2 where most uses are of the category, else 1.
SOFT = {
    "adult": 2, "sex": 2, "sexy": 2, "nude": 2, "nudes": 2, "erotic": 2, "fetish": 2, "hookup": 2, "webcam": 1, "dating": 1, "singles": 1, "rated": 1, "x": 1,
    "betting": 2, "bets": 2, "gambling": 2, "poker": 2, "jackpot": 2, "roulette": 2, "blackjack": 2, "bet": 1, "slots": 1, "lottery": 1, "bonus": 1, "win": 1, "odds": 1,
    "pills": 2, "steroids": 2, "pharmacy": 1, "prescription": 1, "meds": 1, "cheap": 1, "discount": 1, "deals": 1,
    "torrent": 2, "torrents": 2, "cracked": 2, "crack": 1, "serial": 1, "download": 1, "downloads": 1, "free": 1, "mp3": 1,
    "payday": 2, "loan": 1, "loans": 1, "credit": 1, "cash": 1, "replica": 2, "counterfeit": 2,
    "spam": 2, "ads": 2, "popunder": 2, "adserver": 2, "doorway": 2, "popup": 1, "track": 1, "tracker": 1, "tracking": 1, "click": 1, "clicks": 1, "affiliate": 1, "farm": 1,
}
SOFT_LIMIT, FEWEST_SOFT = 3, 2
#: Terms that a table may have.
MOST_TERMS = 100_000

_ESCAPE = re.compile(r"%([2-7][0-9A-Fa-f])")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) after the first '://'; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:stop]


class Rules:
    """The longest rule that fits a host and path, found by the host's suffixes."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        at = 0
        while host and at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1 or -1
        return best


def plain(url: str) -> str:
    """A url as it is searched: escapes of ASCII characters decoded, A-Z lower-cased."""
    if "%" in url:
        url = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url)
    return url.translate(_LOWER)


def terms_of(table: DataFrame) -> tuple[list[str], dict[str, int]]:
    """(strict terms, soft terms with weights) of a table (term, kind, weight) of MOST_TERMS rows at most.

    Rows without a term, or of another kind, say nothing; a null weight is 1; of several
    rows of one soft term the largest weight counts; a term of both kinds is strict.
    """
    rows = table.select("term", "kind", "weight").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    named = [(r["term"].translate(_LOWER), r["kind"], 1 if r["weight"] is None else r["weight"]) for r in rows if r["term"]]
    strict = {t for t, kind, _ in named if kind == "strict"}
    soft: dict[str, int] = {}
    for t, _, weight in sorted(x for x in named if x[1] == "soft" and x[0] not in strict):
        soft[t] = weight  # in ascending order, so the largest stays
    return sorted(strict), soft


class Vocabulary:
    """Counts of distinct strict and soft terms in a url, and the weight of the soft ones."""

    def __init__(self, strict: Sequence[str], soft: dict[str, int]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for term, weight in [*((t.translate(_LOWER), w) for t, w in soft.items()), *((t.translate(_LOWER), None) for t in strict)]:
            if term:
                self.auto.add_word(term, (term, weight))
        self.auto.make_automaton()

    def hits(self, url: str) -> tuple[int, int, int]:
        text = plain(url)
        if not len(self.auto):
            return 0, 0, 0
        at = []
        for last, (term, weight) in self.auto.iter(text):
            first = last - len(term) + 1
            if (first == 0 or text[first - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                at.append((-len(term), first, term, weight))
        found, taken = {}, []
        for size, first, term, weight in sorted(at):
            if all(first - size <= a or first >= b for a, b in taken):
                taken.append((first, first - size))
                found[term] = weight
        soft = [w for w in found.values() if w is not None]
        return len(found) - len(soft), len(soft), sum(soft)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT, vocabulary: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits and soft_weight of every row.

    vocabulary: a table (term, kind, weight) in place of strict and soft; kind is strict or soft.
    """
    if vocabulary is not None:
        strict, soft = terms_of(vocabulary)
    prepare(pages.sparkSession, 10_000)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, terms = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = ruled.match(host, path) or (None, None)
                n_strict, n_soft, weight = terms.hits(url or "")
                verdict = verdict or ("block" if n_strict or (n_soft >= FEWEST_SOFT and weight >= soft_limit) else "allow")
                rows.append((host, path, rule, verdict, n_strict, n_soft, weight))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long")


def _list_sql(terms: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


# All terms are single words, so hits at word boundaries are words of the url and none overlap.
SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM u),
e AS (
  SELECT page_id, array_to_string(list_transform(string_split(url, '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[2-7][0-9A-Fa-f]') THEN chr(('0x' || substr(x, 1, 2))::INTEGER) || substr(x, 3) WHEN i > 1 THEN '%' || x ELSE x END), '') AS plain
  FROM u),
p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}) AS t(said, rule, rh, rp)),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
w AS (SELECT page_id, list_distinct(regexp_extract_all(translate(plain, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS words FROM e),
n AS (
  SELECT page_id, len(list_intersect(words, {_list_sql(STRICT)}))::BIGINT AS strict_hits, len(list_intersect(words, {_list_sql(list(SOFT))}))::BIGINT AS soft_hits,
         (len(list_intersect(words, {_list_sql(list(SOFT))})) + len(list_intersect(words, {_list_sql([t for t, k in SOFT.items() if k == 2])})))::BIGINT AS soft_weight FROM w)
SELECT p.page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR (soft_hits >= {FEWEST_SOFT} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM p JOIN n USING (page_id) LEFT JOIN best USING (page_id)
"""
