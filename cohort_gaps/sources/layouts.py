"""Published file layouts: fixed values that say where a tidy column stands in each kind of file."""
from __future__ import annotations

# Wide results file, tidy name to header names in order of preference.
WIDE_ID_HEADERS = {"record_type": ["RECTYPE"], "unit_id": ["URN"], "result_name": ["SCHNAME"],
                   "result_postcode": ["PCODE"]}
WIDE_FIGURE_HEADERS = {
    "n_total": ["TPUP"],
    "n_focus": ["TFSM6CLA1A"],
    "n_rest": ["TNOTFSM6CLA1A"],
    "pct_focus": ["PTFSM6CLA1A"],
    "score_all": ["ATT8SCR"],
    "score_focus": ["ATT8SCR_FSM6CLA1A"],
    "score_rest": ["ATT8SCR_NFSM6CLA1A"],
    "progress_all": ["P8MEA"],
    "progress_focus": ["P8MEA_FSM6CLA1A"],
    "progress_rest": ["P8MEA_NFSM6CLA1A"],
    "basics_all": ["PTL2BASICS_94"],
    "basics_focus": ["PTFSM6CLA1ABASICS_94"],
    "basics_rest": ["PTNOTFSM6CLA1ABASICS_94"],
}
WIDE_KEPT_IDS = ["RECTYPE", "LEA", "URN", "SCHNAME", "PCODE"]
RECORD_MAINSTREAM, RECORD_SPECIAL = "1", "2"

# Long results file.
LONG_HEADERS = ["time_period", "school_urn", "school_name", "establishment_type_group", "breakdown_topic",
                "disadvantage_status", "pupil_count", "attainment8_average", "progress8_average",
                "engmath_94_percent"]
LONG_TOPICS = ["Total", "Disadvantage status"]
LONG_GROUPS = {"Disadvantaged": "focus", "Not known to be disadvantaged": "rest"}
LONG_FIGURES = {"pupil_count": "n", "attainment8_average": "score", "progress8_average": "progress",
                "engmath_94_percent": "basics"}

# Unit register.
REGISTER_HEADERS = {
    "unit_id": ["URN"],
    "unit_name": ["EstablishmentName"],
    "postcode": ["Postcode"],
    "area_code": ["LA (code)"],
    "area_name": ["LA (name)"],
    "region": ["GOR (name)"],
    "type_name": ["TypeOfEstablishment (name)"],
    "type_group": ["EstablishmentTypeGroup (name)"],
    "phase": ["PhaseOfEducation (name)"],
    "gender": ["Gender (name)"],
    "religious_character": ["ReligiousCharacter (name)"],
    "admissions": ["AdmissionsPolicy (name)"],
    "setting": ["UrbanRural (name)"],
    "status": ["EstablishmentStatus (name)"],
    "open_date": ["OpenDate"],
    "close_date": ["CloseDate"],
    "zone_code": ["LSOA (code)"],
    "district_code": ["DistrictAdministrative (code)"],
    "district_name": ["DistrictAdministrative (name)"],
    "trust_name": ["Trusts (name)"],
    "easting": ["Easting"],
    "northing": ["Northing"],
}
REGISTER_SENTINELS = ["", "Not Applicable", "Not applicable"]
REGISTER_SENTINEL_COLUMNS = ["zone_code", "district_code", "area_code", "region", "area_name"]
REGISTER_DATE = "dd-MM-yyyy"
LINK_HEADERS = {"unit_id": ["URN"], "link_id": ["LinkURN"], "link_type": ["LinkType"]}

# Zone scores, tidy name to header pattern.
ZONE_PATTERNS = {
    "zone_code": r"^LSOA code",
    "zone_name": r"^LSOA name",
    "district_code": r"^Local Authority District code",
    "district_name": r"^Local Authority District name",
    "zone_score": r"Index of Multiple Deprivation \(IMD\) Score",
    "zone_rank": r"Index of Multiple Deprivation \(IMD\) Rank",
    "zone_decile": r"Index of Multiple Deprivation \(IMD\) Decile",
    "child_score": r"\(IDACI\) Score",
    "child_decile": r"\(IDACI\) Decile",
    "population": r"^Total population",
}

# Postcode directory, newer zone vintage first.
DIRECTORY_HEADERS = {"postcode": ["pcds", "pcd", "pcd7", "pcd8"],
                     "zone_code": ["lsoa21cd", "lsoa21", "lsoa11cd", "lsoa11"]}

# Where the files lie below the input folder.
LONG_FILES = ("ks4", "ees_*.csv")
WIDE_FILES = ("ks4", "england_ks4*.csv")
WIDE_PREFERENCE = ["final", "revised", "provisional"]
REGISTER_FILES = ("gias", "edubasealldata*.csv")
LINK_FILES = ("gias", "links_edubasealldata*.csv")
ZONE_FILES = ("imd", "*.csv")
DIRECTORY_FILES = ("onspd", "*.csv")
