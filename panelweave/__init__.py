"""panelweave: panel and cohort-coverage analytics as Spark DataFrame functions.

Every public function takes DataFrames plus explicit key and parameter names and
returns DataFrames. Nothing is fixed to one country, survey or range of years.
"""
