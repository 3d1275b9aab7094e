"""URL filter: fixed host rules first, then a logistic regression on hashed character n-grams of host and path.

Both parts are DataFrame expressions.  The regression is Spark's own, fitted on one small labelled table
(``MAX_LABELLED`` rows at most); its weights are one short array, applied by array functions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the labelled table; a larger table is refused, not sampled.
MAX_LABELLED = 2000


@dataclass(frozen=True)
class Settings:
    grams: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 15
    steps: int = 100
    l2: float = 3e-4
    threshold: float = 0.5


#: (verdict, host, path): a rule fits its host and every subdomain when the path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

# Real hosts, written down from general knowledge of what they are, by kind and not for the tables here.  The
# first are of the kinds that public block lists name (advertising and tracking networks, gambling, adult, piracy); the
# second are of well-known reference works, schools, public bodies, news and software.
BAD_HOSTS = (
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "adnxs.com", "adsrvr.org", "adform.net", "adroll.com", "advertising.com", "adcolony.com", "admob.com", "adition.com", "adblade.com", "adbrite.com",
    "adriver.ru", "adsterra.com", "adskeeper.co.uk", "mgid.com", "taboola.com", "outbrain.com", "revcontent.com", "criteo.com", "rubiconproject.com", "pubmatic.com", "openx.net", "casalemedia.com", "smartadserver.com",
    "bidswitch.net", "contextweb.com", "spotxchange.com", "tradedoubler.com", "zedo.com", "popads.net", "popcash.net", "propellerads.com", "exoclick.com", "trafficjunky.net", "trafficfactory.biz", "juicyads.com", "clickadu.com",
    "hilltopads.net", "infolinks.com", "media.net", "yieldmo.com", "serving-sys.com", "scorecardresearch.com", "quantserve.com", "chartbeat.com", "hotjar.com", "mixpanel.com", "mouseflow.com", "crazyegg.com", "statcounter.com",
    "clicktale.net", "bluekai.com", "krxd.net", "demdex.net", "omtrdc.net", "rlcdn.com", "tapad.com", "bet365.com", "betfair.com", "bwin.com", "betway.com", "888casino.com", "888poker.com", "pokerstars.com", "partypoker.com",
    "ladbrokes.com", "williamhill.com", "paddypower.com", "unibet.com", "1xbet.com", "22bet.com", "betsson.com", "leovegas.com", "casino.com", "slotomania.com", "stake.com", "draftkings.com", "fanduel.com", "bovada.lv",
    "betonline.ag", "pornhub.com", "xvideos.com", "xnxx.com", "xhamster.com", "redtube.com", "youporn.com", "tube8.com", "spankbang.com", "chaturbate.com", "livejasmin.com", "stripchat.com", "bongacams.com", "cam4.com",
    "adultfriendfinder.com", "ashleymadison.com", "brazzers.com", "thepiratebay.org", "1337x.to", "rarbg.to", "kickasstorrents.to", "torrentz2.eu", "yts.mx", "fmovies.to", "putlocker.is",
)
GOOD_HOSTS = (
    "wikipedia.org", "wikimedia.org", "python.org", "debian.org", "gnu.org", "kernel.org", "apache.org", "mozilla.org", "w3.org", "ietf.org", "rfc-editor.org", "archive.org", "gutenberg.org", "arxiv.org", "nature.com",
    "science.org", "plos.org", "nih.gov", "nasa.gov", "noaa.gov", "usgs.gov", "loc.gov", "cdc.gov", "europa.eu", "who.int", "un.org", "unesco.org", "worldbank.org", "bbc.co.uk", "theguardian.com", "nytimes.com",
    "washingtonpost.com", "reuters.com", "apnews.com", "lemonde.fr", "spiegel.de", "zeit.de", "elpais.com", "corriere.it", "nhk.or.jp", "cnn.com", "npr.org", "economist.com", "mit.edu", "stanford.edu", "harvard.edu",
    "berkeley.edu", "ox.ac.uk", "cam.ac.uk", "ethz.ch", "tum.de", "epfl.ch", "cern.ch", "github.com", "gitlab.com", "stackoverflow.com", "stackexchange.com", "sourceforge.net", "bitbucket.org", "readthedocs.io", "npmjs.com",
    "pypi.org", "rust-lang.org", "golang.org", "ruby-lang.org", "php.net", "perl.org", "postgresql.org", "sqlite.org", "oracle.com", "microsoft.com", "apple.com", "ibm.com", "intel.com", "redhat.com", "ubuntu.com",
    "archlinux.org", "freebsd.org", "britannica.com", "merriam-webster.com", "imdb.com", "goodreads.com", "allrecipes.com", "bbcgoodfood.com", "tripadvisor.com", "lonelyplanet.com", "nationalgeographic.com",
    "smithsonianmag.com", "britishmuseum.org", "louvre.fr", "metmuseum.org", "khanacademy.org", "coursera.org", "openstreetmap.org", "weather.gov", "metoffice.gov.uk", "nhs.uk", "service-public.fr", "bund.de", "ikea.com",
    "lego.com", "bahn.de", "sncf.com",
)
# Forms that either kind takes, so that they tell nothing.  A site's ending is among them: two hundred hosts cannot tell what
# an ending says (hardly a well-known good one ends in .net, many advertising networks do).
_ENDINGS = ("com", "net", "org", "info", "io", "co.uk", "de", "fr")
_PREFIXES = ("", "www.", "m.", "cdn.")
_PATHS = ("", "/", "/index.html", "/about", "/2024/05/12", "/a/b/c.html", "/en/", "/p/1234", "/search")


def default_labelled(spark: SparkSession) -> DataFrame:
    """``url, bad``: the names of the hosts above, each under four prefixes with an ending and a path told by a hash, which is
    blind to the label.

    The table is small and general; another of the kind may be given to :func:`judge_urls`."""
    rows = []
    for bad, hosts in ((1.0, BAD_HOSTS), (0.0, GOOD_HOSTS)):
        for host in hosts:
            name = host.split(".")[0]
            for prefix in _PREFIXES:
                k = zlib.crc32((prefix + name).encode())
                rows.append((f"http{'s' * (k % 2)}://{prefix}{name}.{_ENDINGS[k // 2 % len(_ENDINGS)]}{_PATHS[k // 16 % len(_PATHS)]}", bad))
    return spark.createDataFrame(rows, "url string, bad double")


def unseen_auc(labelled: DataFrame, s: Settings | None = None, folds: int = 4) -> float:
    """How often a bad URL scores above a good one (ties half) when no URL of the scored fold's names was trained on.

    A name is the longest part between dots of a host, so it is held out under all its prefixes and endings."""
    s = s or Settings()
    host, _ = parts(F.col("url"))
    site = F.array_max(F.transform(F.split(host, r"\."), lambda x: F.struct(F.length(x), x)))
    at = labelled.where("bad is not null").select("url", "bad", F.pmod(F.xxhash64(site), F.lit(folds)).alias("fold"))
    scores = None
    for fold in range(folds):
        model = train(at.where(F.col("fold") != fold), s)
        part = score(at.where(F.col("fold") == fold), model, s)
        scores = part if scores is None else scores.unionByName(part)
    # at most MAX_LABELLED rows
    got = scores.select("bad", "bad_score").collect()
    good, bad = (sorted(r["bad_score"] for r in got if r["bad"] == v) for v in (0, 1))
    return sum((bisect_left(good, x) + bisect_right(good, x)) / 2 for x in bad) / (len(good) * len(bad))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _grams(host: Column, path: Column, s: Settings) -> Column:
    """Buckets of the distinct n-grams of ``^host path$``.  The characters are split once, so the work is in proportion to
    the URL's length."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$")), "")

    def of_length(c: Column, n: int) -> Column:
        gram = lambda i: F.concat(*(F.coalesce(F.get(c, i - 1 + j), F.lit("")) for j in range(n)))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(n), gram(i)), F.lit(s.buckets)).cast("int"))

    def lists(c: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*(of_length(c, n) for n in s.grams))))

    # a list of one, so that the characters are made once and bound to a name
    return F.get(F.transform(F.array(chars), lists), F.lit(0))


def _logit(grams: Column, weights: Column, offset: Column) -> Column:
    return F.aggregate(grams, offset, lambda acc, g: acc + F.element_at(weights, g + 1))


def train(labelled: DataFrame, s: Settings = Settings()) -> tuple[list[float], float]:
    """Weights and offset from ``labelled(url, bad)``; null labels are ignored, a single class gives weights of 0.

    The fit is Spark's own logistic regression over sparse vectors of the buckets that occur, both classes weighing the
    same.  A bucket that no labelled URL has weighs 0, so a long or strange URL is not pulled to either side by it.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    host, path = parts(F.col("url"))
    rows = labelled.where("bad is not null").select(_grams(host, path, s).cast("array<string>").alias("grams"), F.col("bad").cast("double").alias("bad"))
    low, high, n, share = rows.agg(F.min("bad"), F.max("bad"), F.count("*"), F.avg("bad")).first()
    if n > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    if low == high:
        return [0.0] * s.buckets, 0.0
    counted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=s.buckets, binary=True).fit(rows)
    data = counted.transform(rows).withColumn("weight", F.when(F.col("bad") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    fitted = LogisticRegression(labelCol="bad", weightCol="weight", maxIter=s.steps, regParam=s.l2, standardization=False).fit(data)
    weights = [0.0] * s.buckets
    for bucket, w in zip(counted.vocabulary, fitted.coefficients.toArray()):
        weights[int(bucket)] = float(w)
    return weights, float(fitted.intercept)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, nulls where none does; equal lengths go by the rule's text."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def score(urls: DataFrame, model: tuple[list[float], float], s: Settings = Settings()) -> DataFrame:
    """``urls`` with ``bad_score``, the model's probability that its ``url`` is bad."""
    weights, offset = model
    host, path = parts(F.col("url"))
    literal = F.from_json(F.lit("[" + ",".join(f"{w:.6g}" for w in weights) + "]"), "array<double>")
    return urls.withColumn("bad_score", 1 / (1 + F.exp(-_logit(_grams(host, path, s), literal, F.lit(offset)))))


def judge_urls(pages: DataFrame, labelled: DataFrame, s: Settings = Settings(), rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_score`` for every row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has an empty host and path and is judged like any other; ids may be null or
    repeated; other columns are not read; an empty table gives no rows.  No shuffle.
    """
    host, path = parts(F.col("url"))
    rows = score(pages.select("page_id", "url"), train(labelled, s), s).select("page_id", host.alias("host"), path.alias("path"), "bad_score")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("bad_score") >= s.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "bad_score")
