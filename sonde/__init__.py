"""Root-cause analytics over operational telemetry, expressed as Spark DataFrames.

Every operator takes and returns DataFrames keyed by ``incident_id``, so all
incidents are analysed in one job.
"""
