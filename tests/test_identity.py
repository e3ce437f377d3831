"""Identity across registers, on invented names."""

import pytest

from ledgerlight.operators import identity as D

LORDS = [(1, "Lord Sample of Westby"), (2, "Lord Sample of Eastby"), (3, "Lord Sample")]


def decide(spark, members, officers):
    m, o = spark.createDataFrame(members, "member long, name string"), spark.createDataFrame(officers, "officer long, name string")
    claims = D.identity_claims(m, o)
    outcomes = {r.member: (r.outcome, r.linked, r.dropped) for r in D.member_outcomes(m, o, claims).collect()}
    return sorted((r.member, r.officer, r.tier, r.dropped) for r in claims.collect()), outcomes


def test_a_forename_takes_its_own_records_only(spark):
    claims, outcomes = decide(spark, [(1, "Jane Sample"), (2, "Dame Ann Other")], [(10, "SAMPLE, Jane Mary"), (11, "SAMPLE, Jane"), (12, "SAMPLE, John"), (13, "SAMPLE, Jane, Dame"), (14, "OTHER, Zoe, Dame"), (15, "OTHER, , Dame")])
    assert claims == [(1, 10, "surname_forename_title", False), (1, 11, "surname_forename_title", False)]
    assert outcomes == {1: ("surname_forename_title", 2, 0), 2: ("ambiguous", 0, 0)}  # records without a forename aren't taken either


def test_alone_with_one_forename(spark):
    claims, outcomes = decide(spark, [(1, "Baroness Sample of Westby")], [(10, "SAMPLE, Ann, Lady"), (11, "SAMPLE, Ann, Lady Sample Of Westby Kg"), (12, "SAMPLE, Ann, Lady Sample Of Eastby")])
    assert claims == [(1, 10, "surname_title_only", False), (1, 11, "surname_title_only", False)]
    assert outcomes == {1: ("surname_title_only", 2, 0)}


@pytest.mark.parametrize("other", ["SAMPLE, Zoe, Lady", "SAMPLE, , Lady"])
def test_alone_with_several_forenames_is_refused(spark, other):
    claims, outcomes = decide(spark, [(1, "Baroness Sample")], [(10, "SAMPLE, Ann, Lady"), (11, other)])
    assert (claims, outcomes) == ([], {1: ("ambiguous", 0, 0)})


def test_a_member_without_a_seat_takes_no_record_with_one(spark):
    assert decide(spark, [(1, "Lord Sample")], [(10, "SAMPLE, Tom, Lord Sample Of Westby")])[1] == {1: ("ambiguous", 0, 0)}


def test_several_members_need_the_seat_on_the_record_itself(spark):
    claims, outcomes = decide(spark, LORDS, [(10, "SAMPLE, Tom, Lord Sample Of Westby"), (11, "SAMPLE, Tom, Lord"), (12, "SAMPLE, Tom, The Lord Sample Of Eastby Kt")])
    assert claims == [(1, 10, "surname_title_territorial", False), (2, 12, "surname_title_territorial", False)]
    assert outcomes[3] == ("ambiguous", 0, 0)


def test_a_seat_of_two_people_is_refused(spark):
    claims, outcomes = decide(spark, LORDS, [(10, "SAMPLE, Tom, Lord Sample Of Westby"), (11, "SAMPLE, Tim, Lord Sample Of Westby")])
    assert claims == [] and outcomes[1] == ("ambiguous", 0, 0)


def test_baron_and_lord_share_a_bucket(spark):
    claims, outcomes = decide(spark, [(1, "Lord Sample of Westby"), (2, "Baron Sample of Eastby")], [(10, "SAMPLE, Tom, Lord")])
    assert claims == [] and set(outcomes.values()) == {("ambiguous", 0, 0)}
    assert decide(spark, [(1, "Baron Sample")], [(10, "SAMPLE, Tom, Lord")])[1] == {1: ("surname_title_only", 1, 0)}


def test_titles_must_agree(spark):
    assert decide(spark, [(1, "Jane Sample"), (2, "Sir Tom Other")], [(10, "SAMPLE, Jane, Dame"), (11, "OTHER, Tom")])[1] == {1: ("no_candidate", 0, 0), 2: ("no_candidate", 0, 0)}


def test_a_record_claimed_twice_goes_to_neither(spark):
    members = [(1, "Jane Sample"), (2, "Ms Jane Sample"), (3, "Lord Other of Westby"), (4, "Lord Tom Other")]
    claims, outcomes = decide(spark, members, [(10, "SAMPLE, Jane"), (11, "OTHER, Tom, Lord Other Of Westby"), (12, "OTHER, Tom, Lord")])
    assert {(m, o): d for m, o, _, d in claims} == {(1, 10): True, (2, 10): True, (3, 11): True, (4, 11): True, (4, 12): False}
    assert outcomes == {1: ("officer_collision", 0, 1), 2: ("officer_collision", 0, 1), 3: ("officer_collision", 0, 1), 4: ("surname_forename_title", 1, 1)}


def test_offices_and_nameless_members(spark):
    assert decide(spark, [(1, "The Lord Bishop of Westby"), (2, ""), (3, None)], [(10, "BISHOP, Tom, Lord"), (11, None), (12, ", Tom")])[1] == {1: ("functional_title", 0, 0), 2: ("no_candidate", 0, 0), 3: ("no_candidate", 0, 0)}


def test_repeated_rows_count_once(spark):
    claims, _ = decide(spark, [(1, "Lord Sample")] * 3, [(10, "SAMPLE, Tom, Lord")] * 2)
    assert claims == [(1, 10, "surname_title_only", False)]


def links(spark, *rows):
    return spark.createDataFrame(rows, D.LINK)


def test_changes(spark):
    stored = links(spark, (1, 10, "surname_title_only", 0.6), (2, 20, "surname_title_only", 0.6), (3, 30, "surname_title_only", 0.6))
    claims = spark.createDataFrame([(1, 10, "surname_title_only", 0.6, False), (2, 20, "surname_title_territorial", 0.85, False), (3, 30, "surname_title_only", 0.6, True), (4, 40, "surname_title_only", 0.6, False)], f"{D.LINK}, dropped boolean")
    changes = D.link_changes(stored, claims)
    assert sorted((r.member, r.action, r.confidence) for r in changes.collect()) == [(1, "keep", 0.6), (2, "update", 0.85), (3, "delete", 0.6), (4, "create", 0.6)]
    assert sorted((r.member, r.officer, r.tier) for r in D.reconciled(changes).collect()) == [(1, 10, "surname_title_only"), (2, 20, "surname_title_territorial"), (4, 40, "surname_title_only")]
    again = D.link_changes(D.reconciled(changes), claims)
    assert {r.action for r in again.collect()} == {"keep"}


def test_a_bulk_delete_is_refused(spark):
    stored = links(spark, *((i, i, "surname_title_only", 0.6) for i in range(30)))
    none = spark.createDataFrame([], f"{D.LINK}, dropped boolean")
    changes = D.link_changes(stored, none)
    with pytest.raises(RuntimeError):
        D.reconciled(changes)
    assert D.reconciled(changes, allow_bulk_delete=True).count() == 0
    few = stored.where("member < 19")  # too few for a share to mean anything
    assert D.reconciled(D.link_changes(few, none)).count() == 0


def test_a_record_of_two_members_is_never_stored(spark):
    stored = links(spark)
    claims = spark.createDataFrame([(1, 10, "surname_title_only", 0.6, False), (2, 10, "surname_title_only", 0.6, False)], f"{D.LINK}, dropped boolean")
    with pytest.raises(RuntimeError):
        D.reconciled(D.link_changes(stored, claims))


def crowd(spark, n):
    """n members and n records of one surname, title and forename, and as many of each who are alone."""
    members = [(i, "Jane Sample") for i in range(n)] + [(n + i, f"Jane Other{chr(97 + i)}") for i in range(n)]
    officers = [(i, "SAMPLE, Jane") for i in range(n)] + [(n + i, f"OTHER{chr(97 + i)}, Jane") for i in range(n)]
    return spark.createDataFrame(members, "member long, name string"), spark.createDataFrame(officers, "officer long, name string")


def test_claims_of_a_crowd_are_made_last(spark):
    claims = D.identity_claims(*crowd(spark, 20))
    assert claims.count() == 420 and claims.where("NOT dropped").count() == 20
    # nothing is joined or grouped by record once claims are made, and those of no crowd are told before
    plan = claims.where("NOT dropped")._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert "surname" in plan[1].split("\n")[0] and "Filter" not in plan[0] and "Aggregate" not in plan[0]


def test_outcomes_without_making_claims(spark):
    members, officers = crowd(spark, 20)
    counted = D.member_outcomes(members, officers).collect()
    assert sorted(counted) == sorted(D.member_outcomes(members, officers, D.identity_claims(members, officers)).collect())
    assert {(r.outcome, r.linked, r.dropped) for r in counted} == {("officer_collision", 0, 20), ("surname_forename_title", 1, 0)}
