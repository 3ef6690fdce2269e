"""Fixed values of the crash feed that results must agree on."""

from __future__ import annotations

# The crash columns in the order of the feed.
CRASH_COLUMNS = (
    "crash_record_id", "crash_date", "posted_speed_limit", "traffic_control_device", "device_condition",
    "weather_condition", "lighting_condition", "first_crash_type", "trafficway_type", "alignment",
    "roadway_surface_cond", "road_defect", "report_type", "crash_type", "private_property_i", "hit_and_run_i",
    "damage", "date_police_notified", "prim_contributory_cause", "sec_contributory_cause", "street_no",
    "street_direction", "street_name", "beat_of_occurrence", "num_units", "crash_month", "most_severe_injury",
    "injuries_total", "injuries_fatal", "injuries_incapacitating", "injuries_non_incapacitating",
    "injuries_reported_not_evident", "injuries_no_indication", "injuries_unknown", "crash_hour",
    "crash_day_of_week", "idot_control_no", "latitude", "longitude", "location", "intersection_related_i",
    "crash_date_est_i", "photos_taken_i", "statements_taken_i", "work_zone_i", "work_zone_type", "lane_cnt",
    "workers_present_i", "dooring_i",
)

# Envelope keys around a payload.
ENVELOPE_KEYS = ("record_id", "batch_id", "table_name", "ingestion_ts", "payload")

# Columns that hold whole numbers without sign.
WHOLE_NUMBER_COLUMNS = (
    "posted_speed_limit", "street_no", "injuries_total", "injuries_fatal", "injuries_incapacitating",
    "injuries_non_incapacitating", "injuries_reported_not_evident", "injuries_no_indication", "injuries_unknown",
    "crash_hour",
)
