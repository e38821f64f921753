"""Event-window analytics for wearable sensor series on Spark.

Every operator takes and returns DataFrames. Canonical tables:

* samples  - session_id, t, one column per channel (t is any integer clock)
* markers  - marker_id, session_id, t, event
* sessions - session_id, day_str
* windows  - window_id, session_id, day_str, start_t, end_t, label, horizon
* features - window_id, session_id, day_str, label, one DOUBLE per feature
"""
