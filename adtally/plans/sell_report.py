"""Sales report by site or publisher: current period against the previous one.

``SellReport`` is an immutable description. ``rows`` gives the lazy report frame, and page,
total and count are queries over it. The plan is one pass over the facts, one shuffle on the
site, and joins on frames with one row per site. Filters first narrow the facts to the sites
they choose.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.functions import metrics
from adtally.functions.metrics import RATIOS, SYSTEM_SHARE
from adtally.operators import filters, paging, spine, stored_pages, totals
from adtally.operators.cumulative import cumulative_window_sums
from adtally.operators.managers import kept_by
from adtally.operators.panel import with_panel
from adtally.operators.periods import Period, lookback_before
from adtally.operators.window_sums import COMPARED, COUNTERS, MEASURES, MONEY, site_window_sums
from adtally.session import checkpointed
from adtally.sources.tables import SellTables

# Columns a page may be sorted by. Three shown columns are left out on purpose:
# buy_cpm, delta_buy_cpm and block_shows_empty.
SORTABLE = (
    ("name", "profit", "system_profit", "percent_system_profit")
    + COUNTERS
    + tuple(ratio.name for ratio in RATIOS if ratio.name != "buy_cpm")
    + ("delta_profit", "delta_system_profit", "delta_percent_system_profit")
    + tuple(f"delta_{counter}" for counter in COUNTERS)
    + tuple(f"delta_{ratio.name}" for ratio in RATIOS if ratio.name != "buy_cpm")
    + ("effective_block_shows_pc",)
)

COMPARED_FIGURES = (
    ("profit", "system_profit", "percent_system_profit")
    + COUNTERS
    + tuple(ratio.name for ratio in RATIOS)
)
FIGURES = tuple(
    name for figure in COMPARED_FIGURES for name in (figure, f"delta_{figure}")
) + ("block_shows_empty", "effective_block_shows_pc")
DELTA_BASES = tuple(f"{figure}_for_delta" for figure in COMPARED_FIGURES)

SITE_NAME, SITE_URL = "site_name", "site_url"


@dataclass(frozen=True)
class SellReport:
    tables: SellTables
    period: Period
    by_publisher: bool = False
    filters: tuple[filters.SpineFilter, ...] = ()
    computed_rows: DataFrame | None = None

    def where(self, *more: filters.SpineFilter) -> SellReport:
        """The same report with more filters; they apply to every figure of it."""
        return replace(self, filters=self.filters + more, computed_rows=None)

    def spine(self) -> DataFrame:
        """The reported sites with all their attributes, without figures."""
        return self._filtered_sums({filters.SITES, filters.USERS}).select(
            "site_id",
            "site_name",
            "site_url",
            "user_id",
            "country_id",
            "profit_type",
            "min_teaser_rating",
            "email",
            "subsystem_id",
            "is_exchanger",
            "is_disabled",
        )

    def rows(self) -> DataFrame:
        """All report rows, including sites whose dimension row is missing."""
        if self.computed_rows is not None:
            return self.computed_rows
        return self._named_sums().selectExpr("id", "name", *_selected(_figures()), *self._owner_columns())

    def figures(self) -> DataFrame:
        """All report rows without names and owners, which saves the joins for them."""
        if self.computed_rows is not None:
            return self.computed_rows
        grouped = self._by_publisher() if self.by_publisher else self._by_site(set())
        return grouped.selectExpr("id", *_selected(_figures()))

    def stored(self) -> SellReport:
        """The report with its rows computed once, for several queries over it."""
        return replace(self, computed_rows=checkpointed(self.rows()))

    def count(self) -> DataFrame:
        return self.figures().agg(F.count("*").alias("rows"))

    def total(self) -> DataFrame:
        return totals.grand_total(self.figures())

    def page(
        self,
        page: int = 1,
        items: int = 50,
        order: str = "profit",
        descending: bool = False,
        site_label: str = SITE_NAME,
    ) -> DataFrame:
        """One page as displayed. Sites and publishers without a dimension row are not shown.

        Sorting by name uses the stored name, which is null without traffic in the current
        window, while the shown name always comes from the dimension.
        """
        return self._sorted_page(page, items, order, descending, site_label).drop("sort_key")

    def store_pages(self, folder: str, order: str = "profit", descending: bool = False, site_label: str = SITE_NAME, ranges: int | None = None) -> None:
        """Store all rows that pages in this order show, for ``stored_page``."""
        stored_pages.write(self._sorted_page(1, 0, order, descending, site_label), folder, "sort_key", descending, ranges)

    @staticmethod
    def stored_page(spark: SparkSession, folder: str, page: int = 1, items: int = 50, descending: bool = False) -> DataFrame:
        """A page of rows that ``store_pages`` stored in this direction."""
        return stored_pages.read(spark, folder, "sort_key", descending, page, items).drop("sort_key")

    def page_with_panel(
        self,
        page: int = 1,
        items: int = 50,
        order: str = "profit",
        descending: bool = False,
        site_label: str = SITE_NAME,
    ) -> DataFrame:
        """A page with the extra site details; a publisher page has none."""
        shown = self._sorted_page(page, items, order, descending, site_label)
        if self.by_publisher:
            return shown.drop("sort_key")
        detailed = with_panel(shown, self.tables)
        return detailed.orderBy(paging.ordering("sort_key", descending), "id").drop("sort_key")

    def _sorted_page(
        self, page: int, items: int, order: str, descending: bool, site_label: str
    ) -> DataFrame:
        """Figures are worked out for the rows of the page only; the sort needs just one of them."""
        order = order if order in SORTABLE else "profit"
        if self.computed_rows is not None:
            rows, figures = self.computed_rows, {name: name for name in FIGURES}
        else:
            rows, figures = self._named_sums(), _figures()
        owned = "user_known" if self.by_publisher else "site_known AND user_known"
        ready = rows.where(owned).withColumn("sort_key", F.expr(figures.get(order, order)))
        shown = paging.page_of(ready, "sort_key", descending, page, items)
        label = "email" if self.by_publisher else site_label
        site = [] if self.by_publisher else ["id AS site_id"]
        flags = ("user_id", "is_disabled", "is_exchanger", "sort_key")
        displayed = _selected({name: figures[name] for name in FIGURES})
        return shown.selectExpr("id", *site, f"{label} AS name", *flags, *displayed)

    @staticmethod
    def page_total(page: DataFrame) -> DataFrame:
        return totals.page_total(page)

    def _owner_columns(self) -> list[str]:
        owner = ["user_id", "email", "is_disabled", "is_exchanger", "user_known"]
        return owner if self.by_publisher else owner + ["site_name", "site_url", "site_known"]

    def _named_sums(self) -> DataFrame:
        """Sums per site or publisher with the attributes of their owner."""
        if self.by_publisher:
            grouped = spine.with_user_attributes(self._by_publisher(), self.tables.users)
            return grouped.withColumn("name", F.expr("IF(current_rows > 0, email, NULL)"))
        grouped = self._by_site({filters.SITES, filters.USERS})
        return grouped.withColumn("name", F.expr("IF(current_rows > 0, site_name, NULL)"))

    def _filtered_sums(self, extra_needs: set[str]) -> DataFrame:
        needs = set(extra_needs).union(*(f.needs for f in self.filters if f.row_condition is not None))
        lookback = lookback_before(self.period.current.start) if filters.LOOKBACK in needs else None
        if self.tables.cumulative_sell is not None and not self.period.is_today_included:
            rows = cumulative_window_sums(self._narrowed(self.tables.cumulative_sell), self.period, lookback)
        else:
            rows = site_window_sums(
                self._narrowed(self.tables.day_sell),
                self.period,
                self._narrowed(self.tables.hour_sell) if self.period.is_today_included else None,
                lookback,
            )
        if needs & {filters.SITES, filters.USERS}:
            rows = rows.join(self._attributes(needs), "site_id", "left")
        for one in self.filters:
            if one.row_condition is not None:
                rows = rows.where(one.row_condition)
        return rows

    def _attributes(self, needs: set[str]) -> DataFrame:
        sites = spine.site_attributes(self.tables.sites)
        return spine.with_user_attributes(sites, self.tables.users) if filters.USERS in needs else sites

    def _narrowed(self, facts: DataFrame) -> DataFrame:
        """Facts of the sites that the filters choose, before anything is summed.

        The chosen ids are one narrow column. Where Spark broadcasts it, facts are narrowed in
        the scan's tasks and a site with very many rows is still one partial row per task.
        Where it is too large for that, facts and ids meet in a shuffled semi join, of which
        Spark splits the partition of such a site, and each part sums its own rows.
        """
        for one in self.filters:
            if one.fact_condition is not None:
                facts = facts.where(one.fact_condition)
            if one.site_ids is not None:
                facts = facts.join(one.site_ids(self.tables), "site_id", "left_semi")
        plain = [f for f in self.filters if f.condition is not None or f.narrow_sites is not None]
        usual = [f for f in plain if not f.keeps_unknown and f.unless_empty is None]
        if usual:
            facts = facts.join(self._chosen(usual), "site_id", "left_semi")
        for one in plain:
            if one.unless_empty is not None:
                facts = kept_by(facts, "site_id", self._chosen([one]), one.unless_empty)
            elif one.keeps_unknown:
                others = self._attributes(set(one.needs)).where(~F.coalesce(one.condition, F.lit(False)))
                facts = facts.join(others.select("site_id"), "site_id", "left_anti")
        return facts

    def _chosen(self, chosen: list[filters.SpineFilter]) -> DataFrame:
        """Ids of the sites of the dimension that pass all of the given filters."""
        sites = self._attributes(set().union(*(f.needs for f in chosen)))
        for one in chosen:
            if one.condition is not None:
                sites = sites.where(one.condition)
            if one.narrow_sites is not None:
                sites = one.narrow_sites(sites, self.tables)
        return sites.select("site_id")

    def _by_site(self, needs: set[str]) -> DataFrame:
        return self._filtered_sums(needs).withColumn("id", F.col("site_id"))

    def _by_publisher(self) -> DataFrame:
        """Sites added up per user, before the user dimension is joined.

        Users are looked up by a key that is unique on both sides, so a publisher with very
        many sites does not skew that join. Sites without a user belong to no publisher.
        """
        rows = self._filtered_sums({filters.SITES}).where("user_id IS NOT NULL")
        sums = list(MEASURES) + ["current_rows"]
        sums += [f"{measure}_{side}" for measure in COMPARED for side in ("for_delta", "prev")]
        grouped = rows.groupBy("user_id").agg(*(F.expr(f"sum({name}) AS {name}") for name in sums))
        return grouped.withColumn("id", F.col("user_id"))


def _operands(suffix: str) -> dict[str, str]:
    """Money and counters of one side, in the types the stored ratios are computed in."""
    side = {name: metrics.exact_count(name + suffix) for name in COUNTERS}
    side |= {name: metrics.stored(name + suffix) for name in MONEY}
    shares = f"({side['parent_profit']} + {side['agent_profit']})"
    side["site_raw_profit"] = metrics.stored(f"{side['buyers_expense']} - {shares}")
    side["system_profit"] = metrics.stored(f"{side['site_raw_profit']} - {side['profit']}")
    return side


def _selected(columns: dict[str, str]) -> list[str]:
    return [f"{value} AS {name}" for name, value in columns.items()]


def _figures() -> dict[str, str]:
    """Report columns from the current sums, the delta base and the previous sums.

    The delta of a ratio is the stored current ratio minus the unrounded previous one.
    """
    now, base, before = _operands(""), _operands("_for_delta"), _operands("_prev")
    columns = {}
    for name in ("profit", "system_profit"):
        columns[name] = now[name]
        columns[f"{name}_for_delta"] = base[name]
        columns[f"delta_{name}"] = metrics.stored(f"{base[name]} - {before[name]}")
    for name in COUNTERS:
        columns[name] = name
        columns[f"{name}_for_delta"] = f"{name}_for_delta"
        columns[f"delta_{name}"] = f"{name}_for_delta - {name}_prev"
    for ratio in (SYSTEM_SHARE, *RATIOS):
        shown, compared, earlier = (
            metrics.exact_ratio(side[ratio.numerator], side[ratio.denominator], ratio.factor)
            for side in (now, base, before)
        )
        columns[ratio.name] = metrics.stored(shown)
        columns[f"{ratio.name}_for_delta"] = metrics.stored(compared)
        columns[f"delta_{ratio.name}"] = metrics.stored(f"{metrics.stored(compared)} - {earlier}")
    columns["block_shows_empty"] = "block_shows_empty"
    columns["effective_block_shows_pc"] = metrics.stored(
        metrics.filled_share("block_shows", "block_shows_empty")
    )
    return {name: columns[name] for name in FIGURES + DELTA_BASES}
