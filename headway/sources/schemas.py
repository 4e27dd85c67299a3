"""Declared schemas of the lakehouse's inputs."""

ENRICHED = (
    "vehicle_id string, timestamp string, event_time_ms long, latitude double, longitude double, speed_ms double, heading int, delay_seconds int, door_status int, "
    "line_id string, direction_id int, operator_id int, next_stop_id string, delay_trend double, speed_trend double, distance_since_last_m double, "
    "time_since_last_ms long, is_stopped boolean, stopped_duration_ms long, processing_time long"
)
STOP_EVENTS = "vehicle_id string, stop_id string, line_id string, direction_id int, arrival_time long, delay_at_arrival int, dwell_time_ms long, door_status int, latitude double, longitude double"
RAW = "value string, topic string"
STOPS = "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double, zone_id string"
LINES = "line_id string, line_name string, line_type string, operator_name string"
