"""rootscope: Spark jobs that turn service telemetry into root-cause rankings.

Every operator takes and returns DataFrames.  Feature tables stay in long form
``(instance_id, timestamp, feature, value)``; vectors are ``array<double>``.
"""
