"""Account search: which types are searched, whose accounts, pages and totals."""

import pytest

from adtally.plans.account_search import AccountSearch, ManagerScope, merged_filters
from adtally.sources import synthetic
from adtally.sources.tables import SCHEMAS

ALL = ManagerScope("all", own_id=1)


def search(accounts, filters, user_type=None, scope=ALL):
    return AccountSearch(accounts, filters, scope, user_type)


@pytest.fixture(scope="module")
def accounts(spark, sf_dir):
    return synthetic.accounts_from_parties(spark, sf_dir)


@pytest.mark.parametrize(
    ("filters", "user_type", "expected"),
    [
        ({"email": "x"}, None, ["agent", "buyer", "seller", "exchanger"]),
        ({"site": "x"}, None, ["seller", "exchanger"]),
        ({"src_id": "1"}, None, ["seller", "exchanger"]),
        ({"subsystem": "1"}, None, ["exchanger"]),
        ({"subsystem": "1", "country": "1"}, None, ["seller", "exchanger"]),
        ({"subsystem": "1", "webmoney": "1"}, None, ["exchanger"]),
        ({"crm_status": "1"}, None, ["buyer", "seller", "exchanger"]),
        ({"crm_status": "1"}, "agent", []),
        ({"subsystem": "1"}, "seller", ["seller"]),
        ({"site": "x"}, "buyer", []),
        ({"email": ""}, "exchanger", ["exchanger"]),
    ],
)
def test_searched_types(filters, user_type, expected):
    assert search(None, filters, user_type).searched_types() == expected


@pytest.mark.parametrize(
    ("filters", "expected"),
    [({"email": "x"}, "all"), ({"webmoney": "Z"}, "all"), ({"ad": "a"}, "all"), ({"country": "1"}, "my"), ({"crm_status": "1"}, "my")],
)
def test_all_accounts_need_an_identifying_filter(filters, expected):
    assert search(None, filters).manager_choice() == expected


def test_filters_are_merged_and_unknown_ones_dropped():
    merged = merged_filters({"email": "a", "source": "common", "role": "x"}, {"source": "mark", "evil": "y"})
    assert merged == {"email": "a", "source": "mark"}


def test_no_filter_finds_nothing(accounts):
    assert search(accounts, {}).matches().count() == 0


def test_scopes(spark, accounts):
    def managers_found(scope):
        found = search(accounts, {"campaign": "c1", "country": "country3"}, scope=scope).matches()
        return {row.manager_id for row in found.select("manager_id").distinct().collect()}

    group = spark.createDataFrame([(3,), (8,)], "manager_id long")
    assert managers_found(ALL) == {3}
    assert managers_found(ManagerScope("my", own_id=3)) == {3}
    assert managers_found(ManagerScope("my", own_id=2)) == set()
    assert managers_found(ManagerScope("manager", own_id=2, picked_id=3)) == {3}
    assert managers_found(ManagerScope("my_group", own_id=2, group=group)) == {3}
    assert managers_found(ManagerScope("my_group", own_id=3, group=group.limit(0))) == {3}
    assert managers_found(ManagerScope("my_group", own_id=2, group=group.limit(0))) == set()


def test_first_page_holds_at_most_100_of_every_type(accounts):
    rows = search(accounts, {"email": "example"}).page().collect()
    by_type = {}
    for row in rows:
        by_type.setdefault(row.user_type, []).append(row.email)
    assert {kind: len(emails) for kind, emails in by_type.items()} == {
        "agent": 5, "buyer": 100, "seller": 100, "exchanger": 25,
    }
    everything = sorted(r.email for r in accounts.where("user_type = 'buyer'").select("email").collect())
    assert sorted(by_type["buyer"]) == everything[:100]


def test_pages_of_one_type_follow_each_other(accounts):
    one = search(accounts, {"email": "buyer1"}, "buyer")
    total = one.matches().count()
    ids = [row.id for page in range(1, 40) for row in one.page(page).collect()] if total < 200 else None
    first, second = one.page(1).collect(), one.page(2).collect()
    assert len(first) == 50 and len(second) == 50
    assert first[-1].email <= second[0].email
    assert ids is None or len(set(ids)) == total


def test_totals_depend_on_type_and_page_count(spark):
    row = dict.fromkeys(["email", "subsystem", "site", "src_id", "country", "webmoney", "crm_status", "source", "campaign", "medium", "ad"], "x")

    def account(number, kind):
        return (number, kind, *row.values(), 1, 1)

    few = [account(n, kind) for n, kind in enumerate(["agent", "buyer", "seller", "exchanger"])]
    many = [account(100 + n, "buyer") for n in range(50)]
    schema = SCHEMAS["accounts"].replace("decimal(16,4)", "int")
    accounts = spark.createDataFrame(few + many, schema)
    given = {"email": "x"}
    assert search(accounts, given, "agent").totals().first().pages == 1
    assert search(accounts, given, "seller").totals().count() == 0
    assert search(accounts, given, "buyer").totals().first().asDict() == {
        "user_type": "buyer", "accounts": 51, "balance": 51, "pages": 2,
    }
    assert search(accounts, given).totals().count() == 0
    assert search(accounts, {"email": "none"}, "agent").totals().count() == 0
