"""Study constants; every operator takes them as defaults of its parameters."""

from datetime import date

# They must equal those of the published study for equal results.
STUDY_START, STUDY_END = date(2015, 1, 1), date(2026, 12, 31)
COVID_START, COVID_END, COVID_YEAR_END, REMOTE_FALL = date(2020, 3, 16), date(2020, 8, 15), date(2021, 8, 15), 2020
CAMPUS_M, NEAR_M, MAJOR_MIN_STUDENTS = 400, 1000, 1000
COLLEGE_AGE, VALID_AGE, PLACEHOLDER_BIRTH_YEARS = (18, 24), (16, 90), (1969,)
MIN_DURATION_S, MAX_DURATION_S, EDGE_HOURS = 60, 24 * 3600, 48
NON_PUBLIC_STATION = r"(?i)\b(test|warehouse|repair|depot)\b|^8D (OPS|QC)\b|^MTL-"
TYPICAL_WEEKS, CLOSED_SHARE = 9, 0.5
RAIN_MM, HEAVY_RAIN_MM, SNOW_MM, ICE_C, HOT_C = 1, 10, 10, 0, 30
SNAP_M, NEIGHBOUR_M, SAME_STATION_M = 100, 1000, 10
MIN_YEAR_WEEKS, MIN_PANEL_WEEKS, MIN_KIND_WEEKS = 20, 52, 4
LEGACY_RENAME = {
    "starttime": "started_at", "stoptime": "ended_at", "start station id": "start_station_id", "start station name": "start_station_name",
    "start station latitude": "start_lat", "start station longitude": "start_lng", "end station id": "end_station_id", "end station name": "end_station_name",
    "usertype": "rider_type",
}
LEGACY_RIDER = {"Subscriber": "member", "Customer": "casual"}
MODERN_BIKE = {"classic_bike": "classic", "docked_bike": "classic", "electric_bike": "electric"}
FALL_EVENTS = ("fall_classes_start", "fall_exams_end")
SPRING_EVENTS = ("spring_classes_start", "february_break_start", "february_break_end", "spring_break_start", "spring_break_end", "spring_exams_end", "commencement")
OPTIONAL_EVENTS = ("february_break_start", "february_break_end")
