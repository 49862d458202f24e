"""Permissions and group hierarchies, as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

#: Links of users and places that are broadcast at most; more are shuffled.
MOST_LINKS = 1_000_000
#: Users that come one after another for each row of a place.
RUN = 256


def closure(groups: DataFrame) -> DataFrame:
    """(group_id, ancestor_id, distance): each group with itself and all that is above it, to any depth.

    Pointer doubling: every round joins paths to paths, so a depth of n takes about log2(n) rounds, each of which is checkpointed.
    The groups of a cycle are each other's ancestors, at the distance of the first meeting.
    """
    reach = settled(groups.where("group_id is not null and group_id <> id").select(F.col("id").alias("group_id"), F.col("group_id").alias("ancestor_id"), F.lit(1).alias("distance")).distinct())
    known = reach.count()
    while True:
        on = reach.select(F.col("group_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"), F.col("distance").alias("more"))
        longer = reach.join(on, "ancestor_id").where("group_id <> above").select("group_id", F.col("above").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = settled(reach.union(longer).groupBy("group_id", "ancestor_id").agg(F.min("distance").alias("distance")))
        found = reach.count()
        if found == known:
            return reach.union(groups.select("id", "id", F.lit(0)).distinct())
        known = found


def ancestors(groups: DataFrame) -> DataFrame:
    """(group_id, ancestor_id): each group with itself and its ancestors."""
    return closure(groups).select("group_id", "ancestor_id")


@dataclass
class Access:
    """Who may see which devices, not multiplied out, as pairs through groups are users times devices.

    A device's place is the sorted array of its groups, so that a device has one place and (user, place) gives each pair once.
    """

    places: DataFrame  # device_id, place: one row a device
    through: DataFrame  # user_id, place: one row a pair, by links to the place's groups or to groups above them
    direct: DataFrame  # user_id, device_id: one row a pair, with those that also come through a place
    broadcast: bool  # whether through has MOST_LINKS rows at most

    def beyond(self) -> DataFrame:
        """The direct pairs that don't come through a place too."""
        p, t = self.places.withColumnRenamed("device_id", "x_device"), self.through.select(F.col("user_id").alias("x_user"), F.col("place").alias("x_place"))
        at = self.direct.join(p, F.col("device_id").eqNullSafe(F.col("x_device")), "left")
        return at.join(t, F.col("user_id").eqNullSafe(F.col("x_user")) & (F.col("place") == F.col("x_place")), "left_anti").select("user_id", "device_id")

    def met(self, df: DataFrame) -> DataFrame:
        """df (with place) once for each user of its place, in tasks of equal numbers of rows of df; what comes of it is not shuffled.

        Within a part of a place's rows, rows come by RUN users, then by row of df, then by user: as columns these are runs of one value and
        one short list again and again, which files hold in a small part of the bytes that rows without order take.
        """
        n, names = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c for c in df.columns if c != "place"]
        part = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if c != "place" and "map<" not in kind]), F.lit(4 * n))
        dealt = df.select("place", part.alias("x_part"), F.struct(*names).alias("x_row")).repartitionByRange(n, "place", "x_part")
        parts = dealt.groupBy("place", "x_part").agg(F.collect_list("x_row").alias("x_rows"))
        if self.broadcast:
            both = parts.join(F.broadcast(self.lists("place")), "place")
        else:
            links = self.lists("place", F.pmod(F.xxhash64("user_id"), F.lit(n)).alias("x_slice"))
            both = parts.withColumn("x_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).repartition(n, "place", "x_slice").join(links, ["place", "x_slice"])
        # Generated code holds all rows that come of one of its input rows; transform is not part of it, so that these are RUN rows at most.
        rows = both.select("place", "x_users", F.explode(F.transform("x_rows", lambda x: x)).alias("x_row"))
        return rows.select("place", "x_row", F.explode("x_users").alias("user_id")).select("place", *[F.col("x_row")[c].alias(c) for c in names], "user_id")

    def lists(self, *keys) -> DataFrame:
        """through as lists x_users of RUN users at most, by keys."""
        links = self.through.select("user_id", *keys)
        by = [c for c in links.columns if c != "user_id"]
        run = links.withColumn("x_run", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("user_id")) - 1) / RUN))
        return run.groupBy(*by, "x_run").agg(F.flatten(F.collect_list(F.array("user_id"))).alias("x_users")).drop("x_run")

    def pairs(self) -> DataFrame:
        """(user_id, device_id), each once."""
        return self.met(self.places).select("user_id", "device_id").union(self.beyond())

    def users(self, df: DataFrame) -> DataFrame:
        """df (with device_id) once for each user of its device, with user_id."""
        names = ["user_id", *df.columns]
        return self.met(df.join(self.places, "device_id")).select(names).union(df.join(self.beyond(), "device_id").select(names))

    def counts(self) -> DataFrame:
        """(device_id, users): how many users each device has, without the pairs themselves."""
        through = self.places.join(self.through.groupBy("place").agg(F.count("*").alias("users")), "place").select("device_id", "users")
        more = self.beyond().groupBy("device_id").agg(F.count("*").alias("users"))
        return through.union(more).groupBy("device_id").agg(F.sum("users").alias("users"))

    def objects(self, df: DataFrame, key: str) -> DataFrame:
        """(device_id, key) for what users have (user_id, key), each once: places get their users' keys before devices do."""
        at = self.through.join(df, "user_id").select("place", key).distinct()
        return self.places.join(at, "place").select("device_id", key).union(self.direct.join(df, "user_id").select("device_id", key)).distinct()

    def without(self, users: list[int]) -> Access:
        """The same for all but these users, and for rows that name a user."""
        ok = ~F.col("user_id").isin(list(users))
        return Access(self.places, self.through.where(ok), self.direct.where(ok), self.broadcast) if users else self


def access(user_device: DataFrame, user_group: DataFrame, groups: DataFrame, devices: DataFrame) -> Access:
    """Direct links, and devices whose group or an ancestor of it the user is linked to."""
    by_group = user_group.withColumnRenamed("group_id", "ancestor_id").join(ancestors(groups), "ancestor_id").select("user_id", "group_id")
    places = devices.groupBy(F.col("id").alias("device_id")).agg(F.sort_array(F.collect_set("group_id")).alias("place"))
    known = places.select("place").distinct().select("place", F.explode("place").alias("group_id"))
    through = settled(by_group.join(known, "group_id").select("user_id", "place").distinct())
    return Access(places, through, user_device.select("user_id", "device_id").distinct(), through.count() <= MOST_LINKS)


def permitted_devices(user_device: DataFrame, user_group: DataFrame, groups: DataFrame, devices: DataFrame, with_groups: bool = True) -> DataFrame:
    """(user_id, device_id): direct links, and devices whose group or an ancestor of it the user is linked to."""
    if not with_groups:
        return user_device.select("user_id", "device_id").distinct()
    return access(user_device, user_group, groups, devices).pairs()


def permitted(df: DataFrame, links: DataFrame, user_id: int, key: str = "device_id") -> DataFrame:
    """Rows of df that the user may see."""
    return df.join(links.where(F.col("user_id") == user_id).select(F.col("device_id").alias(key)).distinct(), key, "left_semi")


def descendants(groups: DataFrame, roots: list[int]) -> DataFrame:
    """Ids of the groups below roots, roots included, to any depth."""
    return closure(groups).where(F.col("ancestor_id").isin(roots)).select(F.col("group_id").alias("id")).distinct()


def looked_up(devices: DataFrame, groups: DataFrame, own: DataFrame, of_groups: DataFrame, default: float, server: float | None = None) -> DataFrame:
    """(id, value): a device's own attribute, else its nearest group's, else the server's, else the default. Of two values of one group the lower counts."""
    met = closure(groups).join(of_groups.select(F.col("group_id").alias("ancestor_id"), "value"), "ancestor_id").where("value is not null")
    nearest = met.groupBy("group_id").agg(F.min(F.struct("distance", "value"))["value"].alias("x_group"))
    d = devices.select("id", "group_id").join(own.groupBy("id").agg(F.min("value").alias("x_own")), "id", "left").join(nearest, "group_id", "left")
    return d.select("id", F.coalesce("x_own", "x_group", F.lit(server).cast("double"), F.lit(default)).alias("value"))
