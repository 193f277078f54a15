"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The labelled table, in plain order: URLs to keep, then URLs to block. Hosts of public sites, and invented ones of the kinds that spam, gambling, adult, piracy and fraud sites use.
_KEEP = """
en.wikipedia.org/wiki/Cartography  www.bbc.co.uk/news/world-europe-6120  www.nytimes.com/2019/05/04/science/space  www.theguardian.com/books/2020/review
arxiv.org/abs/1706.03762  www.nature.com/articles/d41586  github.com/apache/spark/issues  docs.python.org/3/library/re.html  stackoverflow.com/questions/11227809
www.lemonde.fr/culture/article/2021  www.spiegel.de/wissenschaft/mensch  elpais.com/sociedad/2018  www.nasa.gov/missions/apollo  www.who.int/health-topics/malaria
developer.mozilla.org/en-US/docs/Web/HTML  www.britannica.com/biography/Marie-Curie  www.gutenberg.org/ebooks/1342  archive.org/details/texts  www.loc.gov/collections/maps
www.reuters.com/markets/europe  apnews.com/article/elections  www.economist.com/leaders/2022  www.smithsonianmag.com/history  www.nationalgeographic.com/animals/birds
www.stanford.edu/research  ocw.mit.edu/courses/physics  www.ox.ac.uk/admissions  www.cam.ac.uk/news  www.uni-heidelberg.de/de/studium  www.ethz.ch/en/the-eth-zurich.html
www.allrecipes.com/recipe/12345/bread  www.seriouseats.com/knife-skills  www.bonappetit.com/story/soup  www.weather.gov/forecast/oslo  www.metoffice.gov.uk/climate
www.gov.uk/browse/driving  www.europa.eu/institutions  www.un.org/en/about-us/charter  www.imdb.com/title/tt0111161  www.goodreads.com/book/show/4671
www.rottentomatoes.com/m/casablanca  www.lonelyplanet.com/italy/rome  www.tripadvisor.com/Attractions  www.railway.example.edu/timetable  www.cityorchestra.org/concerts/spring
blog.gardener.net/2015/06/roses  forum.woodworkers.org/thread/881  www.smalltownpaper.com/local/council  www.villageschool.org/parents/calendar  www.chessclub.org/results/2014
mathforum.org/dr.math/faq  www.stringquartet.info/biography  podcasts.historians.net/episode/17  www.birdwatching.org/species/heron  www.knitting-patterns.org/scarf
www.medlineplus.gov/diabetes.html  www.mayoclinic.org/diseases-conditions/flu  kids.kiddle.co/Volcano  www.howstuffworks.com/engine.htm  www.instructables.com/id/Table
www.openstreetmap.org/relation/51477  linux.die.net/man/1/grep  www.w3.org/TR/xml  tools.ietf.org/html/rfc2616  pubmed.ncbi.nlm.nih.gov/31452104
www.sciencedirect.com/science/article  www.jstor.org/stable/1833  plato.stanford.edu/entries/kant  www.poetryfoundation.org/poems/44272  www.folger.edu/hamlet
www.sueddeutsche.de/politik/wahl  www.corriere.it/cronache/2016  www.asahi.com/articles/national  www.dn.se/kultur  yle.fi/uutiset/3-11
www.sports-reference.com/olympics  www.espn.com/soccer/table  www.uefa.com/history  www.cyclingnews.com/races/paris-roubaix  www.runnersworld.com/training
"""
_BLOCK = """
cheap-viagra-online.biz/buy-now  www.best-casino-bonus.info/free-spins  xxx-livecams.tv/teen/girls  replica-rolex-watches.shop/sale  payday-loans-fast.us/apply
win-iphone-prize.xyz/claim?id  download-cracked-software.ru/keygen/photoshop  hot-milf-videos.net/porn/watch  onlinepokerroom.bet/deposit-bonus  buy-cialis-cheap.com/pills/order
free-porn-tube.xxx/anal/hd  slots-jackpot-city.casino/register  get-rich-quick-system.click/secret  weight-loss-miracle-pills.top/diet/order  fake-id-cards.store/buy
casino-royal-bets.com/roulette/bonus  sexdating-local.club/hookup/now  adult-chat-room.live/webcam  hacked-accounts.pw/netflix/free  torrent-warez-full.cc/crack/serial
serial-keys-generator.net/crack  essay-writing-cheap.biz/order-now  make-money-online.win/click-here  bitcoin-doubler.top/invest/profit  crypto-giveaway-elon.live/claim
cheap-handbags-outlet.shop/louis-vuitton-replica  sexy-escort-service.com/girls/paris  betting-odds-bonus.net/sportsbook  forex-profit-signals.info/join-now  lottery-winner-claim.xyz/prize
viagra-cialis-levitra.org/discount/pills  erotic-massage-girls.net/book  nude-celebs-leaked.xxx/gallery  instant-cash-loan.pro/no-credit-check  spam-links-directory.info/seo/backlinks
buy-followers-cheap.com/instagram/likes  cheap-backlinks-seo.biz/packages  penis-enlargement-pills.net/order  debt-consolidation-offers.click/apply-now  free-robux-generator.xyz/hack
keygen-crack-download.top/windows/activator  watch-free-movies-hd.cc/stream/full  pirated-ebooks-free.ru/download  luxury-replica-bags.store/gucci/sale  online-pharmacy-noprescription.com/xanax
blackjack-vip-casino.bet/free-chips  slot-machine-bonus.win/play-now  poker-freeroll-bonus.com/signup  bingo-cash-prizes.club/join  bet365-bonus-codes.info/claim
teen-webcam-sex.live/show  porn-videos-free.tv/categories  xxx-movies-tube.com/amateur  milf-dating-hookup.net/meet  adult-toys-cheap.shop/vibrator
phishing-bank-login.pw/verify/account  paypal-verify-account.xyz/login  secure-login-update.click/bank/confirm  free-gift-card-codes.win/amazon  claim-your-prize-now.top/winner
hot-deals-discount-pills.biz/offer  miracle-hair-growth.click/buy-now  lose-20-pounds-fast.info/diet-pills  diet-pills-discount.net/garcinia  testosterone-booster-cheap.com/order
cheap-oem-software.biz/download  warez-portal-crack.net/games  hack-facebook-password.xyz/free  spy-phone-app-cracked.cc/apk  modded-apk-free.top/download
earn-dollars-daily.click/system  work-from-home-rich.biz/millionaire  pyramid-profit-club.win/invest  binary-options-bonus.net/deposit  stock-tips-guaranteed.info/profit
russian-brides-dating.com/hot  asian-girls-escort.net/vip  sugar-daddy-hookup.club/join-free  one-night-stand-sex.xyz/local  camgirls-nude-free.tv/live
"""


def labelled_urls() -> list[tuple[str, str, int]]:
    """The labelled table: (host, path, 1 for a URL to block)."""
    parts = ((u.partition("/"), y) for urls, y in ((_KEEP, 0), (_BLOCK, 1)) for u in urls.split())
    return [(host, "/" + path.partition("?")[0], y) for (host, _, path), y in parts]


BITS = 16


def grams(host: str, path: str, low: int = 3, high: int = 5) -> np.ndarray:
    """Distinct hashed character n-grams of the host and of the path, marked by where they stand."""
    found = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(low, high + 1):
            for k in range(max(len(s) - n + 1, 0)):
                found.add(zlib.crc32(f"{mark}{s[k : k + n]}".encode("utf-8", "replace")) & ((1 << BITS) - 1))
    return np.fromiter(found, np.int64, len(found))


def train(table: list[tuple[str, str, int]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3, keep: float = 2.0) -> np.ndarray:
    """Weights (the last is the bias); a URL to keep counts `keep` times, as most of the web's are; by gradient steps scaled by the sums of squared gradients. The table is small and fixed, so this runs on the driver."""
    x = [grams(h, p) for h, p, _ in table]
    y = np.array([t for *_, t in table], float)
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    at = np.concatenate(x) if x else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(x)), [len(f) for f in x])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=len(x))))
    for _ in range(rounds):
        z = np.bincount(doc, w[at], len(x)) * scale + w[-1]
        d = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, 1.0, keep)
        g = np.bincount(at, (d * scale)[doc], len(w)) / max(len(x), 1) + l2 * w
        g[-1] = d.mean() if len(x) else 0
        seen += g * g
        w -= rate * g / np.sqrt(seen) * 0.2
    return w


def probability(w: np.ndarray, host: str, path: str) -> float:
    x = grams(host, path)
    z = (w[x].sum() / np.sqrt(max(1, len(x))) if len(x) else 0.0) + w[-1]
    return float(1 / (1 + np.exp(-z)))


def host_of(url: Column) -> Column:
    """After the first `://` up to / ? # or the end, A-Z lower-cased; empty without it."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, action); null if none does."""
    out = F.lit(None).cast("struct<rule: string, action: string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules=RULES, table: list[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block), one row for each row of pages (page_id, url, ...).

    A rule fits its host and all hosts below it where the path begins with the rule's; of those that fit, the longest
    (host and path together) decides, else the regression: block from `threshold` on. A URL that is null or has no
    `://` has an empty host and path. Hosts and paths of any length are judged whole; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result. Only the url column is read, nothing is
    shuffled, and the model (half a megabyte, whatever the input) goes out with the tasks.
    """
    w = train(table if table is not None else labelled_urls())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = lru_cache(1 << 16)(lambda h, p: probability(w, h, p))
        for b in batches:
            p = [score(h, x) for h, x in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "p_block"])

    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    scored = ruled.mapInArrow(run, "page_id bigint, host string, path string, rule string, action string, p_block double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
