"""When each request of a crawl is due, so that a host keeps its rate however many requests and tasks it has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import request_url

#: Requests a second of a host, and tasks that its requests are dealt over.
PER_SECOND, LANES = 5, 16


@dataclass(frozen=True)
class Policy:
    """attempts of a request, and the milliseconds to wait after the n-th failed one, given a random number below 1."""

    name: str
    attempts: int
    wait: Callable[[int, float], float]


#: A page in a browser tries six times and waits random powers, a tool eleven times and waits powers of two.
BROWSER = Policy("browser", 6, lambda failed, random: (10 * random) ** (failed - 1))
TOOL = Policy("tool", 11, lambda failed, random: 2.0 ** (failed - 1))
POLICIES = {p.name: p for p in (BROWSER, TOOL)}


def placed(rows: DataFrame, group: str, order: list[str], salts: int = 64) -> DataFrame:
    """Adds place, from 0, in the group, by a hash of `order` and then `order`, and n, the group's rows.

    No task gets a group whole: places are counted in the parts that the hash makes, and a part's first place is the sum
    of the parts before it.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit("place"), *order), F.lit(salts)).cast("int"))
    sums = salted.groupBy(group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    of_group = Window.partitionBy(group)
    first = sums.select(group, "__salt", F.coalesce(F.sum("__n").over(of_group.orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.sum("__n").over(of_group).alias("n"))
    own = salted.withColumn("__own", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order)) - 1)
    return own.join(first, [group, "__salt"]).withColumn("place", F.col("__first") + F.col("__own")).drop("__salt", "__own", "__first")


def schedule(requests: DataFrame, per_second: float = PER_SECOND, lanes: int = LANES) -> DataFrame:
    """(url, host, n, place, lane, lanes, due) for the distinct URLs of requests (url), encoded as they are asked for.

    The requests of a host are due one after the other, 1 / per_second apart: `due` in seconds from the start. They are
    dealt over `lanes` in turn, at most as many as there are, so a host of any size is the work of many tasks; a lane asks
    every lanes / per_second seconds, so all lanes together keep the host's rate. URLs without a host share one that is
    empty; null URLs are left out.
    """
    urls = requests.filter("url is not null").select(request_url(F.col("url")).alias("url")).distinct()
    hosts = urls.withColumn("host", F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("AUTHORITY"))), F.lit("")))
    of = F.least(F.col("n"), F.lit(lanes)).cast("int")
    out = placed(hosts, "host", ["url"]).withColumn("lanes", of).withColumn("lane", (F.col("place") % F.col("lanes")).cast("int"))
    return out.select("url", "host", "n", "place", "lane", "lanes", (F.col("place") / F.lit(float(per_second))).alias("due"))
