"""URL filters: fixed host and path rules first, else logistic regression on hashed character n-grams.

The regression is trained on the driver from a small labelled table of URLs (at most MAX_LABELLED rows); its weights
(2**BITS doubles) are what is broadcast.  Everything else is a projection: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick

BITS = 14
SIZES = (3, 4, 5)
MAX_LABELLED = 50_000
THRESHOLD = 0.5
#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The small labelled table, written by hand for this library: urls of well-known kinds of sites, most of them invented
#: under real-looking names, and a verdict by kind.  Every fourth url of each class is held out in the tests.
WANTED = """
https://en.wikipedia.org/wiki/Photosynthesis https://docs.python.org/3/library/json.html https://www.bbc.co.uk/news/science-environment
https://www.nature.com/articles/d41586-020-00502-w https://arxiv.org/abs/1706.03762 https://www.gutenberg.org/ebooks/1342
https://developer.mozilla.org/en-US/docs/Web/HTML https://www.nasa.gov/missions/voyager/ https://www.who.int/news-room/fact-sheets
https://www.gov.uk/register-to-vote https://www.lemonde.fr/planete/article/2021/05/03/climat.html https://www.spiegel.de/wissenschaft/
https://elpais.com/cultura/2020-11-02/ https://www.theguardian.com/books/2019/oct/12/reviews https://stackoverflow.com/questions/11227809
https://github.com/apache/spark/blob/master/README.md https://www.nytimes.com/section/world https://www.loc.gov/collections/
https://www.mit.edu/research/ https://news.ycombinator.com/item?id=2921983 https://www.imdb.com/title/tt0068646/ http://www.fao.org/3/i3437e.pdf
https://weather.gov/forecast/today http://museum.bronze-age-finds.org/exhibits/2014 https://library.college-catalog.edu/record/88121
https://blog.plantcare-journal.net/2018/04/pruning-roses https://www.riverside-school.org/calendar/term-2
http://cooking.homestead-kitchen.com/recipes/lentil-soup.html https://forum.bikerepair-help.net/t/brake-cable/3321
https://www.citycouncil-northam.gov/planning/documents https://journals.oceanstudies.org/vol12/issue3/tides
https://www.gardenersweekly.co.uk/articles/soil-types http://www.oldmaps-archive.org/county/1890/sheet-14
https://travel.slowrail.eu/routes/alps-by-train https://www.hikingtrails-peak.net/walks/ridge-loop https://physics.stackexchange.com/questions/2110
https://lists.debian.org/debian-devel/2015/06/ https://www.chess-club-harrow.org.uk/fixtures https://www.astronomy-nights.com/guide/saturn
https://bibliotheque.ville-lyon.fr/expositions/manuscrits https://www.stadtarchiv-ulm.de/bestaende https://museo.prado-amigos.es/obras/goya
https://www.bakers-guild.org/bread/rye https://health.county-clinic.org/vaccination/schedule https://www.woodwork-basics.com/joints/dovetail
https://podcast.history-hour.net/episodes/101 https://www.lawreview-notes.edu/2011/contracts https://www.farmersmarket-dale.com/opening-hours
https://www.birdwatch-north.org/sightings/2020/05 https://school.maths-puzzles.net/year7/fractions https://music.choir-score.org/bach/bwv-227
https://www.local-theatre.co.uk/whats-on https://www.kinderbuch-lesen.de/buecher/maerchen https://actualites.region-centre.fr/transport
http://poetry.reading-room.net/poems/dickinson https://www.software-engineer-notes.com/posts/testing https://data.census-tables.gov/population/2010
https://www.railway-modellers.org.uk/scale/00 https://recetas.cocina-casera.es/gazpacho https://www.volcano-observatory.org/reports/etna
https://www.language-learner.net/grammar/dative https://www.savings-explained.org/guides/compound-interest
http://people.physics-dept.edu/~hansen/lectures/week4.html https://www.parish-news.org.uk/2016/autumn https://www.zoo-educators.org/animals/otter
https://www.bridge-engineers.com/case-studies/arch https://www.sewing-patterns-free.net/skirts https://news.harbour-times.com/2019/08/ferry
https://www.chemistry-teacher.org/labs/titration https://opendata.city-utrecht.nl/bicycles https://www.film-society.org/season/1962
https://www.quiltmakers.net/blocks/log-cabin https://wiki.tabletop-rules.net/dice https://www.swim-club.org/results/2018
""".split()
UNWANTED = """
http://free-casino-bonus.win/slots/play-now https://www.best-online-poker.bet/jackpot?ref=881 http://xxx-hot-videos.xyz/watch/9921
https://adult-cams-live.tv/models/online http://cheap-viagra-pills.top/order/no-prescription https://rx-pharmacy-discount.biz/cialis
http://ads.trackclick-server.com/pixel?uid=33 https://adserver.popunder-media.net/banner/728x90 https://fast-payday-loans.click/apply
http://win-iphone-free-gift.info/claim/prize https://crypto-doubler-win.online/deposit/btc http://bet365-mirror-odds.site/sports/live
https://download-crack-keygen.ru/windows/activator http://torrent-warez-full.cc/movies/2020/hd https://sexy-singles-nearby.date/signup
http://escort-girls-city.xyz/list?page=4 https://replica-watches-outlet.shop/rolex http://cheap-jerseys-wholesale.store/nfl
https://weight-loss-miracle-pills.club/buy http://make-money-fast-home.biz/join https://lottery-winner-online.top/numbers
http://clickbait-viral-stories.buzz/you-wont-believe https://porn-tube-free.xxx/category/teen http://slots-spin-bonus.win/free-spins
https://casino-royal-vip.bet/register?bonus=500 http://online-pharmacy-meds.ru/tramadol https://spam-mailer-tools.cc/bulk/email
http://seo-backlinks-cheap.pro/buy/1000 https://hacked-accounts-shop.cc/netflix http://adult-dating-hookup.date/chat
https://tracker.adclick-exchange.net/c?id=99812 http://popup-ads-network.biz/serve.js https://free-gift-cards-generator.win/amazon
http://loan-approval-instant.click/bad-credit https://betting-tips-fixed.bet/matches http://viagra-online-shop.pharmacy/buy-now
https://nude-celebs-leaks.xyz/gallery/12 http://poker-chips-hack.online/download https://gambling-sites-list.casino/top10
http://bonus-slots-machine.casino/jackpot https://sex-chat-free.cam/rooms http://xxx-movies-download.top/full
https://cheap-cigarettes-online.biz/order http://fake-diploma-buy.pro/degree https://essay-writer-cheap.click/order
http://instagram-followers-buy.shop/10000 https://miracle-cure-diabetes.info/secret http://penny-stocks-pump.biz/alert
https://forex-robot-profit.win/signals http://binary-options-rich.club/trade https://adsense-clicks-bot.cc/buy
http://malware-cleaner-free.download/setup.exe https://your-pc-infected-alert.info/scan http://flash-player-update.download/install.exe
https://serial-keys-crack.ru/photoshop http://warez-games-iso.cc/ps4 https://camgirls-private-show.tv/live
http://hot-milf-videos.xxx/new https://online-bingo-bonus.bet/play http://roulette-system-win.casino/strategy
https://pills-without-prescription.top/xanax http://steroids-shop-online.ru/anabolic https://diet-pills-garcinia.club/trial
http://payday-cash-advance.click/now https://credit-repair-fast.biz/offer http://work-from-home-rich.info/earn
https://free-ringtones-popup.mobi/get http://prize-survey-winner.top/claim https://click-redirect-track.net/go?u=8812
http://banner-exchange-ads.com/show?z=12 https://xxx-hentai-free.xyz/manga http://escorts-vip-agency.date/prices
https://casino-no-deposit.win/codes http://sportsbook-odds-bet.site/bonus https://viagra-cialis-levitra.biz/cart
http://adult-toys-cheap.shop/sale https://bitcoin-giveaway-elon.win/send http://telegram-pump-signals.online/vip
https://spam-comment-bot.cc/license http://link-farm-directory.biz/submit https://doorway-pages-seo.pro/generate
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table that comes with the library: url, label (1: unwanted)."""
    return spark.createDataFrame([(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED], "url string, label int")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and where there is no ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3, F.length(u))).otherwise(F.lit(""))


def features(host: str, path: str) -> np.ndarray:
    """The distinct buckets of the n-grams of host and path, each kind with a mark of its own."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            for i in range(len(part) - n + 1):
                found.add(crc32(f"{mark}{part[i : i + n]}".encode()) & ((1 << BITS) - 1))
    return np.fromiter(found, dtype=np.int64, count=len(found))


class Model:
    """Weights of the buckets; a text's value is their mean over its n-grams, which bounds long URLs."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def probability(self, host: str, path: str) -> float:
        at = features(host, path)
        z = self.bias + (self.weights[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: DataFrame, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """labelled: url, label (1: unwanted).  Rows with a null label are left out; full-batch Adagrad from zero, so the
    result does not depend on the order of the rows."""
    rows = pick(labelled, "url", "label").where(F.col("label").isNotNull())
    rows = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs; this model is for a small table")
    rows = sorted((r["host"], r["path"], int(r["label"])) for r in rows)
    at = [features(h, p) for h, p, _ in rows]
    y = np.array([x[2] for x in rows], dtype=float)
    weights, bias = np.zeros(1 << BITS), 0.0
    if not len(y):
        return Model(weights, bias)
    owner, flat = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)
    scale = 1 / np.sqrt(np.maximum(1, np.array([len(a) for a in at])))
    importance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    g2, b2 = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(epochs):
        z = bias + scale * np.bincount(owner, weights[flat], len(y))
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(flat, (error * scale)[owner], 1 << BITS) / len(y) + decay * weights
        gb = error.mean()
        g2 += g * g
        b2 += gb * gb
        weights -= rate * g / np.sqrt(g2)
        bias -= rate * gb / np.sqrt(b2)
    return Model(weights, bias)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.  A rule fits its host and all its subdomains,
    where the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, model: Model, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the method's probability of unwanted).

    A null url, and one without ://, has an empty host and path, fits no rule, and is judged by the method like any
    other.  Each row gives one row; an empty table gives none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            score = [known.probability(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(score, pa.float64())], ["page_id", "host", "path", "score"])

    rows = pick(pages, "page_id", "url")
    rows = rows.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = rows.mapInArrow(run, "page_id long, host string, path string, score double")
    scored = scored.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r")["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_r")["rule"].alias("rule"), verdict.alias("verdict"), "score")
