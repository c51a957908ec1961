"""URL filters: rules by host and path, and logistic regression on hashed character n-grams.

Rules decide first.  What no rule fits is judged by a logistic regression over hashed
character n-grams of host and path, trained from a small labelled URL table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A small labelled table of invented URLs, 1 to block and 0 to allow.  Hosts to
# allow are common English words, some of which share letters with words to block, and invented names.
LABELLED_URLS = [
    ("https://link-farm.example.org/en/12", 1),
    ("http://www.spam-links.example.net/a/1.html", 1),
    ("https://seo-spam.example.com/de/8", 1),
    ("http://discount-pills.example.com/en/450?page=2", 1),
    ("https://www.buy-meds-cheap.example.org/order", 1),
    ("http://no-prescription-pills.example.net/pills/3", 1),
    ("https://www.lucky-casino.example.org/en/14", 1),
    ("http://online-casino-bonus.example.com/play", 1),
    ("https://slots-jackpot-win.example.net/jackpot/9", 1),
    ("http://m.sports-bets.example.com/en/27#top", 1),
    ("https://best-free-bets-tips.example.org/odds", 1),
    ("http://poker-win.example.net/free/2", 1),
    ("https://ads-network.example.org/en/584", 1),
    ("http://ad-click-track.example.com/click?id=3", 1),
    ("https://track-pixel-ads.example.net/pixel/1.gif", 1),
    ("http://win-free-prize.example.org/claim", 1),
    ("https://free-money-now.example.com/now", 1),
    ("http://xxx-tube.example.net/live/7", 1),
    ("https://adult-chat.example.org/en/61", 1),
    ("http://payday-loans-fast.example.com/apply", 1),
    ("https://replica-watches-sale.example.net/sale", 1),
    ("http://hot-deals-farm.example.org/buy/5", 1),
    ("https://casino-online.example.net/en/5", 1),
    ("http://royal-casino-bonus.example.org/fr/77", 1),
    ("https://m.bets-live.example.com/de/31", 1),
    ("http://cheap-loans.example.net/es/8.html", 1),
    ("https://www.pills-direct.example.com/fr/12", 1),
    ("http://adult-dating.example.net/en/330", 1),
    ("https://ads-click.example.org/de/9", 1),
    ("http://www.track-ads.example.com/en/44#top", 1),
    ("https://spam-seo.example.net/fr/2", 1),
    ("http://free-spins-casino.example.com/de/260", 1),
    ("https://m.win-cash-fast.example.org/en/6", 1),
    ("http://blog.cheap-viagra.example.com/en/18", 1),
    ("https://adult-xxx.example.com/es/41", 1),
    ("http://poker-bets-online.example.org/en/90?page=2", 1),
    ("https://www.content-farm.example.net/de/5/", 1),
    ("http://jackpot-free-win.example.com/fr/63", 1),
    ("http://m.pills-outlet.example.net/en/7", 1),
    ("https://loans-today.example.com/fr/16", 1),
    ("http://www.tracker-beacon.example.org/de/303.html", 1),
    ("https://m.ads-exchange.example.net/es/4", 1),
    ("http://payday-cash.example.com/en/52/", 1),
    ("https://www.shop-replica.example.org/en/7", 1),
    ("http://m.pixel-ads.example.net/fr/16", 1),
    ("https://casino-slots.example.com/de/303.html", 1),
    ("http://www.bets-tips.example.org/es/4", 1),
    ("https://m.adult-live.example.net/en/52/", 1),
    ("http://spam-blast.example.com/en/7", 1),
    ("https://www.click-bonus.example.org/fr/16", 1),
    ("http://m.viagra-shop.example.net/de/303.html", 1),
    ("https://loans-cheap.example.com/es/4", 1),
    ("http://www.tracker-click.example.org/en/52/", 1),
    ("https://m.cams-adult.example.net/en/7", 1),
    ("https://blog.winter.example.com/en/853/", 0),
    ("http://lantern.example.org/en/676", 0),
    ("https://news.harbor.example.net/fr/825", 0),
    ("http://www.garden.example.org/de/320.html", 0),
    ("https://m.weather.example.com/es/25#top", 0),
    ("https://docs.library.example.org/en/685", 0),
    ("http://blog.mountain.example.net/en/960", 0),
    ("https://science.example.org/articles/17", 0),
    ("https://river.example.net/en/770", 0),
    ("http://www.museum.example.org/fr/414", 0),
    ("https://archive.letters.example.net/de/63", 0),
    ("https://school.example.org/en/929/", 0),
    ("http://recipes.kitchen.example.com/es/575", 0),
    ("https://history.example.net/en/667?page=2", 0),
    ("https://blog.orchestra.example.org/en/519", 0),
    ("http://wiki.orchard.example.org/en/14", 0),
    ("https://meadow.example.net/en/311", 0),
    ("https://blog.pottery.example.org/fr/10", 0),
    ("http://almanac.example.org/en/217", 0),
    ("https://www.cedar.example.net/de/148.html", 0),
    ("http://compass.example.org/en/453", 0),
    ("https://violin.example.net/en/384", 0),
    ("http://bridge.example.com/de/71?utm_source=feed", 0),
    ("https://m.village.example.com/fr/9", 0),
    ("https://blog.harvest.example.net/es/231.html", 0),
    ("http://chapel.example.org/en/88/", 0),
    ("https://www.thunder.example.com/en/402#top", 0),
    ("http://m.quarry.example.net/de/17", 0),
    ("https://saffron.example.org/fr/640?page=2&ref=x", 0),
    ("http://blog.copper.example.com/en/59", 0),
    ("https://timber.example.net/es/12.html", 0),
    ("http://www.falcon.example.org/en/301", 0),
    ("https://m.glacier.example.com/de/204/", 0),
    ("http://blog.maple.example.net/fr/33?utm_source=feed", 0),
    ("https://observatory.example.org/en/9", 0),
    ("http://www.linen.example.com/es/87", 0),
    ("https://tailor.example.net/en/150#top", 0),
    ("http://m.basalt.example.org/fr/2", 0),
    ("https://blog.heron.example.com/de/466", 0),
    ("http://windmill.example.net/en/73?page=2", 0),
    ("https://www.ferry.example.org/es/518", 0),
    ("http://grammar.example.com/en/26.html", 0),
    ("https://m.tundra.example.net/fr/190", 0),
    ("http://blog.bakery.example.org/de/5", 0),
    ("http://velmora.example.org/en/5", 0),
    ("https://www.tanquil.example.net/fr/20", 0),
    ("http://m.borexa.example.com/de/113.html", 0),
    ("https://quintaro.example.org/es/8", 0),
    ("http://www.lumedo.example.net/en/340/", 0),
    ("https://m.sarvani.example.com/en/5", 0),
    ("http://fendolin.example.org/fr/20", 0),
    ("https://www.mirakot.example.net/de/113.html", 0),
    ("http://m.oskelun.example.com/es/8", 0),
    ("https://pravidi.example.org/en/340/", 0),
    ("http://www.nalemu.example.net/en/5", 0),
    ("https://m.gisoter.example.com/fr/20", 0),
    ("http://bekanu.example.org/de/113.html", 0),
    ("https://www.torilade.example.net/es/8", 0),
    ("http://m.vapumo.example.com/en/340/", 0),
    ("https://kedisa.example.org/en/5", 0),
    ("http://www.notary.example.net/fr/20", 0),
    ("https://m.bookbinder.example.com/de/113.html", 0),
    ("http://keeper.example.org/es/8", 0),
    ("https://www.bookshop.example.net/en/340/", 0),
    ("http://m.networks.example.com/en/5", 0),
    ("https://cookery.example.org/fr/20", 0),
    ("http://www.pinewood.example.net/de/113.html", 0),
    ("https://m.website.example.com/es/8", 0),
    ("http://server.example.org/en/340/", 0),
    ("https://www.advent.example.net/en/5", 0),
    ("http://m.pillar.example.com/fr/20", 0),
    ("https://winery.example.org/de/113.html", 0),
    ("http://www.farmland.example.net/es/8", 0),
    ("https://m.tracks.example.com/en/340/", 0),
    ("http://linked.example.org/en/5", 0),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; null or no "://": both empty."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def ngrams(host: str, path: str, sizes=(3, 4, 5), buckets: int = 1 << 16) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path, which are kept apart; digits count as 0."""
    got = {0}
    for mark, text in (("h", host), ("p", path)):
        text = f"^{''.join('0' if c.isdigit() else c for c in text)}$"
        for n in sizes:
            got.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode()) % (buckets - 1) + 1 for i in range(len(text) - n + 1))
    return np.array(sorted(got), np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray

    def score(self, host: str, path: str) -> float:
        ids = ngrams(host, path, buckets=len(self.weights))
        z = self.weights[0] + self.weights[ids[1:]].sum() / np.sqrt(max(1, len(ids) - 1))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled URLs as a table (url string, block int)."""
    return spark.createDataFrame(LABELLED_URLS, "url string, block int")


def fit(labelled: DataFrame, most: int = 20_000, buckets: int = 1 << 16, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Logistic regression on at most ``most`` labelled rows (url, block), those of the least URL hash.

    The table is small by contract and ``most`` bounds it, so it is fitted on the driver
    by full-gradient AdaGrad.  Rows with a null label are ignored; no rows: score 0.5.
    """
    rows = labelled.where("block is not null").orderBy(F.xxhash64("url"), "url", "block").limit(most).collect()
    w = np.zeros(buckets)
    if not rows:
        return UrlModel(w)
    docs = [ngrams(*split_url(r["url"]), buckets=buckets) for r in rows]
    x = np.concatenate([np.where(d == 0, 1.0, 1 / np.sqrt(max(1, len(d) - 1))) for d in docs])
    of, ids = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
    y, g2 = np.array([r["block"] for r in rows], float), np.full(buckets, 1e-6)
    for _ in range(rounds):
        z = np.bincount(of, w[ids] * x, len(docs))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(docs)
        g = np.bincount(ids, e[of] * x, buckets) + decay * w / len(docs)
        g2 += g * g
        w = w - rate * g / np.sqrt(g2)
    return UrlModel(w)


class Rules:
    """(verdict, host, path) rules: a rule fits its host and its subdomains if the path starts with the rule's.

    The longest rule text (host and path) wins; of equal ones the first given.  The list
    goes to every task, so at most ``most`` rules are taken.
    """

    def __init__(self, rules: list[tuple[str, str, str]], most: int = 100_000):
        if len(rules) > most:
            raise ValueError(f"more than {most} rules")
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        at = 0
        while host:
            for start, text, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    if best is None or len(text) > len(best[0]):
                        best = (text, verdict)
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``.

    rule: the text of the rule that decides, else null; verdict: the rule's, else block
    if the model's score (which is given for every row) reaches ``threshold``, else allow.
    Null URLs have empty host and path, which the model judges.  Ids may be null or repeat.
    """
    sent = pages.sparkSession.sparkContext.broadcast((Rules(rules), model))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        found, m = sent.value
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            hits = [found.find(*s) for s in split]
            scores = [m.score(*s) for s in split]
            verdicts = [h[1] if h else "block" if s >= threshold else "allow" for h, s in zip(hits, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([h and h[0] for h in hits], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
