"""URL filtering: exact host and path rules first, then logistic regression on hashed character n-grams.

The model is trained here from a small labelled table of URLs (a parameter, bounded by its use as a
literal) by stochastic gradient steps, written as one SQL fold; its DIM + 1 weights then enter the
scoring expression as a literal. No Python runs on the executors.

Defined results: a null url or one without :// has empty host and path, fits no rule and is judged by
the model's bias; empty rules or repeated urls need no care; an empty table gives an empty result;
``filter_urls`` keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIM, EPOCHS, RATE, DECAY = 2048, 40, 1.0, 1e-3
HOLD = 5  # one labelled url in so many never trains
THRESHOLD = 0.5

# The contract's rules (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# The labelled URLs, hosts of either kind under the same domains, prefixes and path forms.
ALLOWED = """
https://en.wikipedia.org/wiki/Photosynthesis
https://docs.python.org/3/library/re.html
https://www.nature.com/articles/s41586-020-2649-2
http://blog.example.net/en/87?page=2
https://m.example.net/fr/301
https://example.com/es/650/
https://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://arxiv.org/abs/1706.03762
https://developer.mozilla.org/en-US/docs/Web/HTML
https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster
https://www.bbc.co.uk/news/science-environment-56837908
https://medlineplus.gov/druginfo/meds/a682878.html
https://plato.stanford.edu/entries/logic-classical/
https://www.britannica.com/biography/Ada-Lovelace
https://blog.rust-lang.org/2021/05/11/edition-2021.html
https://www.lemonde.fr/sciences/article/2021/03/02/climat.html
https://www.spiegel.de/wissenschaft/natur/artikel-1042.html
https://elpais.com/ciencia/2021-04-01/historia.html
http://thonre.example.com/en/12.html
https://blog.hereor.example.net/en/555?utm_source=x
https://www.usenix.org/conference/osdi20/presentation/paper
https://www.history.com/topics/ancient-rome/roman-roads
https://kids.nationalgeographic.com/animals/mammals/facts/red-panda
https://recipes.example.net/en/93/soup.html
https://m.garden.example.com/es/18
http://harbor.example.com/de/940?page=3&ref=x
https://blog.lantern.example.org/fr/7/
https://m.orchard.example.net/en/640#top
http://meadow.example.net/fr/35.html
https://blog.river.example.com/de/208?utm_source=x
https://www.library.example.com/en/1204/
http://m.history-club.example.net/en/77#top
https://stone-bridge.example.com/en/3310.html
https://blog.winter-school.example.net/de/15?page=2&ref=x
https://www.freedom.example.com/fr/871
http://freetown-museum.example.net/en/62?utm_source=feed
https://m.window-garden.example.com/en/5093
https://www.adults-learning.example.net/en/230/
https://bettina.example.com/de/48
http://blog.alphabet.example.net/en/912.html
https://address-book.example.com/en/1007#top
https://www.tracks-and-trails.example.net/en/664
https://m.cheapside.example.com/en/85?page=2
https://pillow-talk.example.net/fr/2201
http://www.spanish-lessons.example.com/es/310/
https://blog.farmhouse.example.net/en/19.html
https://winterthur.example.com/de/4417?utm_source=feed
https://m.sussex.example.net/en/350
https://www.essex-walks.example.com/en/71#top
http://northern.example.net/en/8080
https://blog.weather.example.com/en/26?page=2&ref=x
https://theorem.example.net/en/1729.html
https://www.therapy-notes.example.com/en/504
https://m.shelter.example.net/de/903/
http://ationer.example.com/en/18
https://blog.herting.example.net/en/7031#top
https://www.onread.example.com/fr/55.html
https://m.sheand.example.net/es/402?utm_source=feed
http://edinth.example.com/en/666
https://www.readingroom.example.net/en/1450
https://blog.casita.example.com/es/99/
https://m.slotted-spoon.example.net/en/36
https://www.bonum.example.com/en/21?page=2
http://gameboard.example.net/de/780
https://deal-castle.example.com/en/640
https://blog.loanwords.example.net/en/12#top
https://www.pornic-harbour.example.com/fr/3
https://m.poke-bowl.example.net/en/47.html
https://www.who.int/news-room/fact-sheets/detail/malaria
https://ocw.mit.edu/courses/mathematics/
https://www.openstreetmap.org/about
https://data.europa.eu/en/dataeuropa-academy
https://www.royalsociety.org.uk/science-events
https://forum.woodworking.co.uk/viewtopic.php?t=552
https://shop-history.co.uk/arcades/burlington
https://www.nationalarchives.gov.uk/help-with-your-research/
https://news.ycombinator.com/item?id=1
https://www.deutschlandfunk.de/forschung-aktuell-100.html
https://www.parks.ca/trails/coastal
https://tracker-dogs.org/training/basics
https://thistle.example.net/en/3021
http://www.northeast.example.net/en/48.html
https://m.another.example.net/de/6/
https://blog.theatre.example.net/en/930#top
http://threshing.example.net/fr/207
https://www.stand.example.net/en/15?page=2&ref=x
https://m.handed.example.net/es/88
https://thirteen.example.net/en/4501?utm_source=feed
http://www.station.example.net/en/720
https://blog.wherein.example.net/de/39.html
https://m.outing.example.net/en/1180/
https://inlet.example.net/en/64
http://www.whale.example.net/fr/5#top
https://truth.example.net/en/2750
https://m.strand.example.net/en/33?page=2
https://www.eleven.example.com/en/17
http://blog.thousand.example.com/de/860
https://m.others.example.com/en/96/
""".split()
BLOCKED = """
http://free-casino-bonus.net/slots/jackpot
https://xxx-videos.com/porn/watch?v=1
http://cheap-pills-online.biz/viagra/buy-now
https://ads.tracker.net/click?id=88213
https://shop-members.com/login?redirect=/account
http://adult-dating-hot.info/sex/chat
https://bet365-poker.net/casino/roulette
http://download-crack-keygen.ru/warez/free.exe
https://pixel.adserver.com/banner/728x90.gif
http://replica-watches-cheap.cn/buy/rolex
https://hosted-blogs.net/wp-login.php?action=register
http://payday-loans-fast.biz/apply/now
https://torrent-pirate.to/download/movie
http://porn-tube.xxx/sex/free
https://track.doubleclick.net/ads/pixel
http://win-free-iphone.info/prize/claim
https://seo-backlinks-cheap.biz/order
http://online-casino-slots.ru/play/poker
https://escort-girls.biz/adult/gallery
http://spam-forum.cn/viewtopic.php?t=1&sid=99
https://click.adnetwork.biz/banner/ad.js
http://hot-sex-cams.net/live/xxx
https://www.casino-royal.example.com/en/12.html
http://m.online-casino.example.net/de/455?utm_source=x
https://blog.casino-slots.example.com/en/2087#top
https://mega-casino.example.net/fr/31
http://www.win-casino.example.com/en/640/
https://jackpot-win.example.net/en/77?page=2&ref=x
http://m.lucky-win.example.com/es/18
https://win-prizes.example.net/en/930.html
https://www.free-spins.example.com/en/5061
http://free-money.example.net/de/84#top
https://blog.free-slots.example.com/en/219?utm_source=feed
https://m.free-porn.example.net/en/7
http://best-bets.example.com/en/4410/
https://www.sports-bets.example.net/fr/62.html
https://m.live-bets.example.com/en/108
http://bets-online.example.net/es/3021
https://www.cheap-viagra.example.com/en/56
http://blog.cheap-meds.example.net/en/780#top
https://m.cheap-replica.example.com/de/1339
https://diet-pills.example.net/en/25?page=2
http://www.pills-online.example.com/fr/907.html
https://blog.sleep-pills.example.net/en/48
https://m.adult-cams.example.com/en/6003?utm_source=feed
http://www.adult-videos.example.net/en/71/
https://adult-chat.example.com/de/512
https://blog.hot-adult.example.net/es/33.html
http://m.xxx-tube.example.com/en/240
https://www.xxx-live.example.net/en/18#top
https://teen-xxx.example.com/fr/450
http://blog.porn-hub.example.net/en/9
https://m.sex-dates.example.com/en/2218?page=2&ref=x
https://www.ads-click.example.net/en/640
http://ads-server.example.com/de/31.html
https://m.pop-ads.example.net/en/704
https://blog.ads-pixel.example.com/en/55
http://www.click-track.example.net/fr/1280
https://m.track-user.example.com/en/92/
https://pixel-track.example.net/es/417#top
http://blog.spam-site.example.com/en/3
https://www.mass-spam.example.net/en/860?utm_source=feed
https://m.link-farm.example.com/de/74
http://content-farm.example.net/en/1195.html
https://www.spam-links.example.com/en/508
https://seo-farm.example.net/en/26
http://m.poker-bonus.example.com/fr/340
https://www.texas-poker.example.net/en/12/
https://blog.payday-loans.example.com/en/671
http://quick-loans.example.net/de/93?page=2
https://www.warez-crack.example.com/en/450.html
https://m.keygen-free.example.net/en/7780
http://blog.replica-bags.example.com/en/61#top
https://www.escort-list.example.net/es/205
https://m.casino-bets.example.org/en/11
http://www.adult-free.example.org/en/902
https://cheap-casino.example.org/fr/48.html
https://blog.pills-cheap.example.org/en/330
http://free-ads.example.org/de/17
https://www.spam-win.example.org/en/64
https://betting-tips-win.co.uk/odds/today
http://slots-casino-uk.co.uk/bonus/spins
""".split()


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and / ? # or end, A-Z lower-cased; path up to ? # or end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest rule that fits, as its string (what 0) or verdict (what 1)."""
    out = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit((h + p, v)[what])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def buckets(host: Column, path: Column, dim: int = DIM) -> Column:
    """Hashed character 3- and 4-grams of ^host$ and of the path, each kind apart; linear in the url's length."""

    def grams(s: Column, kind: str) -> Column:
        c = F.split(s, "")

        def of(n: int) -> Column:
            own = F.transform(F.sequence(F.lit(0), F.length(s) - n), lambda i: F.pmod(F.xxhash64(*[F.get(c, i + j) for j in range(n)], F.lit(kind)), F.lit(dim)).cast("int"))
            return F.when(F.length(s) >= n, own).otherwise(F.array().cast("array<int>"))

        return F.concat(of(3), of(4))

    return F.concat(grams(F.concat(F.lit("^"), host, F.lit("$")), "h"), grams(path, "p"))


def train(spark: SparkSession, labelled: DataFrame, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """labelled (url string, label int 1 = block), small by contract -> dim weights and a bias.

    One fold over epochs x rows; each step moves all weights by the row's logistic error.
    """
    host, path = parts(F.col("url"))
    x = labelled.select("url", "label", host.alias("h"), path.alias("p")).withColumn("b", buckets(F.col("h"), F.col("p"), dim))
    x = x.withColumn("n", F.sqrt(F.greatest(F.size("b"), F.lit(1)).cast("double")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim)), lambda j: F.when(j == dim, F.lit(1.0)).otherwise(F.size(F.filter(F.col("b"), lambda v: v == j)) / F.col("n")))
    rows = x.select(F.md5("url").alias("k"), F.struct("b", "n", dense.alias("d"), F.col("label").cast("double").alias("y")).alias("r"))
    fold = f"""
      aggregate(flatten(array_repeat(transform(rows, x -> x.r), {epochs})), array_repeat(0D, {dim + 1}), (w, r) ->
        transform(array(r.y - 1 / (1 + exp(-(w[{dim}] + aggregate(r.b, 0D, (s, b) -> s + w[b]) / r.n)))),
          g -> transform(w, (v, j) -> v * (1 - {rate * decay}D) + {rate}D * g * r.d[j]))[0])"""
    one = rows.agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("rows")).select(F.expr(fold).alias("w"))
    return one.first()["w"]


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label, held): the labelled table; held rows measure the model and never train it."""
    rows = ", ".join(f"('{u}', {y})" for us, y in ((ALLOWED, 0), (BLOCKED, 1)) for u in us)
    return spark.sql(f"SELECT *, crc32(CAST(url AS BINARY)) % {HOLD} = 0 AS held FROM VALUES {rows} AS t(url, label)")


def fitted(spark: SparkSession) -> list[float]:
    """Weights trained on the labelled urls that are not held out."""
    return train(spark, labelled(spark).filter("NOT held"))


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's probability of block."""
    dim = len(weights) - 1
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    b = buckets(host, path, dim)
    z = F.lit(weights[dim]) + F.aggregate(b, F.lit(0.0), lambda s, v: s + F.get(w, v)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, url: Column, weights: list[float], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, p_block and verdict. One scan, no shuffle."""
    host, path = parts(url)
    d = pages.withColumn("host", host).withColumn("path", path)
    h, p = F.col("host"), F.col("path")
    d = d.withColumn("rule", _rule(h, p, rules, 0)).withColumn("p_block", F.round(score(h, p, weights), 6))
    learned = F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow")
    return d.withColumn("verdict", F.coalesce(_rule(h, p, rules, 1), learned))


def filter_urls(pages: DataFrame, url_col: str = "url", weights: list[float] | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rows whose url is allowed; columns unchanged."""
    cols = pages.columns
    w = weights or fitted(pages.sparkSession)
    d = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    out = judge(d, F.col(f"_c{cols.index(url_col)}"), w, rules).filter(F.col("verdict") == "allow")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole pages."""
    pages = scratch.docs_of(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, F.col("url"), fitted(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "p_block")
