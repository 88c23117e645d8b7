"""pagelens: image inventories over tables of crawled web pages, as Spark jobs.

Every operator takes DataFrames and returns a DataFrame. The usual entry point is
:func:`pagelens.plans.pipeline.extract_manifest`.
"""
