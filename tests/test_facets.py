"""Requests over single roles, and groups whose roles lack what is asked for."""

from datetime import UTC, date, datetime

import pytest

from larkspur.plans.facets import CatalogRequest, filtered_groups, matches

SCHEMA = (
    "role_id long, group_id string, company string, title string, season string, pay string, employer_category string, open boolean, requires_citizenship boolean, advanced_degree boolean, release_day_observed boolean, "
    "education_levels array<string>, disciplines array<string>, work_modes array<string>, locations array<string>, education_evidence string, identity_status string, credibility string, visible_at timestamp, release_day date"
)
NAMES = [part.split(" ")[0] for part in SCHEMA.split(", ")]
BLANK = dict.fromkeys(NAMES)
ROLE = BLANK | {
    "role_id": 1, "group_id": "g", "company": "Ørsted A/S", "title": "Data-Science Intern", "season": "Summer 2027", "pay": "$30", "employer_category": "large", "open": True, "requires_citizenship": True, "advanced_degree": True,
    "release_day_observed": True, "education_levels": ["masters"], "disciplines": ["AI-ML"], "work_modes": ["Remote"], "locations": ["San  José", "Oslo"], "education_evidence": "explicit", "identity_status": "unconfirmed",
    "credibility": "official", "visible_at": datetime(2027, 1, 2, 3, tzinfo=UTC), "release_day": date(2027, 1, 1),
}


def row(**changes):
    whole = ROLE | changes
    return tuple(whole[n] for n in NAMES)


CASES = [
    ({}, {}, True), ({"query": "  - "}, {}, True), ({"query": "sci ørs"}, {}, True), ({"query": "cience"}, {}, False), ({"status": "open"}, {}, True), ({"status": "closed"}, {}, False), ({"status": "closed"}, {"open": None}, False),
    ({"employer_categories": ["startup"]}, {}, False), ({"hide_citizenship_required": True}, {}, False), ({"hide_citizenship_required": True}, {"requires_citizenship": None}, True),
    ({"education_level": "masters"}, {}, True), ({"education_level": "undergraduate"}, {}, False), ({"education_level": "undergraduate"}, {"education_evidence": "inferred"}, False),
    ({"education_level": "undergraduate"}, {"education_evidence": "inferred", "advanced_degree": None}, True), ({"education_level": "doctoral"}, {"education_levels": []}, True), ({"education_level": "undergraduate"}, {"education_levels": None, "advanced_degree": False}, True),
    ({"confirmed_only": True}, {}, False), ({"confirmed_only": True}, {"identity_status": None}, True), ({"source": "all"}, {}, True), ({"source": "direct"}, {}, True), ({"source": "community"}, {}, False), ({"source": "corroborated"}, {}, False),
    ({"disciplines": ["machine learning"]}, {}, False), ({"disciplines": ["machine learning"], "discipline_keys": {"Machine Learning": "ai-ml"}}, {}, True), ({"disciplines": ["x"]}, {"disciplines": None}, False),
    ({"seasons": ["summer  2027"]}, {}, True), ({"education_levels": ["PhD"]}, {}, False), ({"education_levels": ["PhD"]}, {"education_evidence": "unspecified"}, True), ({"work_modes": ["remote"]}, {"work_modes": [None, "REMOTE"]}, True),
    ({"has_compensation": True}, {"pay": " \t"}, False), ({"has_compensation": True}, {"pay": None}, False), ({"day": date(2027, 1, 2)}, {}, True), ({"day": date(2027, 1, 1), "day_zone": "America/New_York"}, {}, True),
    ({"day": date(2027, 1, 1), "day_zone": "America/New_York"}, {"release_day": None}, False), ({"day": date(2027, 1, 1)}, {"release_day_observed": False}, True), ({"added_since": datetime(2027, 1, 2, 3, tzinfo=UTC)}, {}, True),
    ({"added_before": datetime(2027, 1, 2, 3, tzinfo=UTC)}, {}, False), ({"locations": ["josé oslo"]}, {}, True), ({"locations": ["paris"]}, {"locations": None}, False),
]


def test_each_facet(spark):
    for request, changes, expected in CASES:
        got = spark.createDataFrame([row(**changes)], SCHEMA).select(matches(CatalogRequest(**request))).first()[0]
        assert got is expected, (request, changes)


def test_roles_of_nulls_answer_only_what_asks_for_nothing(spark):
    blank = spark.createDataFrame([tuple(BLANK.values())], SCHEMA)
    assert blank.where(matches(CatalogRequest())).count() == 1 and blank.where(matches(CatalogRequest(query="a"))).count() == 0
    only = filtered_groups(blank, CatalogRequest()).first()
    assert (only.group_id, only.role_count, only.featured_role, only.titles, only.has_new_roles) == (None, 1, None, None, False)


def test_groups_are_summed_up_over_what_matches(spark):
    later = datetime(2027, 2, 1, tzinfo=UTC)
    roles = [row(role_id=k, title=f"T{k % 5}", visible_at=later if k in (7, 9) else ROLE["visible_at"]) for k in range(1, 12)] + [row(role_id=20, open=False), row(role_id=21, group_id="closed", open=False), row(role_id=22, group_id=None)]
    got = {r.group_id: r for r in filtered_groups(spark.createDataFrame(roles, SCHEMA), CatalogRequest(status="open")).collect()}
    assert set(got) == {"g", None} and (got["g"].role_count, got["g"].unconfirmed_count, got["g"].featured_role, got["g"].has_new_roles) == (11, 11, 7, True)
    assert got["g"].titles == ["T2", "T4", "T1"] and got["g"].locations == ["Oslo", "San  José"] and got[None].titles == ["Data-Science Intern"]
    assert filtered_groups(spark.createDataFrame([], SCHEMA), CatalogRequest()).count() == 0


def test_an_unknown_source_raises():
    with pytest.raises(KeyError):
        matches(CatalogRequest(source="elsewhere"))
