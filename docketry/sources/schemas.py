"""Schemas of raw and conformed tables, and the agencies' column mappings."""

from __future__ import annotations

from dataclasses import dataclass

RAW_INSPECTIONS = "activity_nr string, estab_name string, site_state string, naics_code string, open_date string, close_case_date string, year string, inspection_type string"
RAW_VIOLATIONS = "activity_nr string, standard string, viol_type string, description string, initial_penalty string, current_penalty string, fta_penalty string, year string"
RAW_ACCIDENTS = "accident_key string, activity_nr string, estab_name string, site_state string, naics_code string, accident_date string, year string, description string, fatality string, injury_type string"

INSPECTIONS = "activity_nr string, estab_name string, site_state string, naics_code string, open_date date, close_case_date date, year int, inspection_type string"
VIOLATIONS = (
    "agency string, company_name string, company_name_normalized string, activity_nr string, standard string, viol_type string, description string, "
    "initial_penalty decimal(18,2), current_penalty decimal(18,2), fta_penalty decimal(18,2), site_state string, site_city string, naics_code string, sic_code string, "
    "violation_date date, year int, facility_id string, violation_type string, enforcement_action string"
)
ACCIDENTS = "accident_key string, activity_nr string, estab_name string, site_state string, naics_code string, accident_date date, year int, description string, fatality boolean, injury_type string"


@dataclass(frozen=True)
class AgencySource:
    """How an agency's columns map to the common violation columns."""

    agency: str
    company: str
    columns: tuple[str, ...]
    mapping: dict[str, str]


# The columns that each agency delivers.
SOURCES = {
    "EPA": AgencySource(
        "EPA", "facility_name",
        ("facility_name", "facility_id", "state", "county", "naics_code", "violation_date", "year", "violation_type", "penalty_amount", "enforcement_action"),
        {"company_name": "facility_name", "facility_id": "facility_id", "site_state": "state", "naics_code": "naics_code", "violation_date": "violation_date", "year": "year", "violation_type": "violation_type", "current_penalty": "penalty_amount", "enforcement_action": "enforcement_action"},
    ),
    "MSHA": AgencySource(
        "MSHA", "mine_name",
        ("mine_name", "operator_name", "mine_id", "state", "violation_date", "year", "violation_type", "penalty_amount"),
        {"company_name": "mine_name", "facility_id": "mine_id", "site_state": "state", "violation_date": "violation_date", "year": "year", "violation_type": "violation_type", "current_penalty": "penalty_amount"},
    ),
    "FDA": AgencySource(
        "FDA", "firm_name",
        ("firm_name", "firm_id", "state", "violation_date", "year", "violation_type", "product_category", "enforcement_action"),
        {"company_name": "firm_name", "facility_id": "firm_id", "site_state": "state", "violation_date": "violation_date", "year": "year", "violation_type": "violation_type", "enforcement_action": "enforcement_action"},
    ),
}


def register(source: AgencySource) -> None:
    """Adds an agency to the registry."""
    SOURCES[source.agency] = source
