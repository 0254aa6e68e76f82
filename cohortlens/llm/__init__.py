"""Training-data operators: near duplicates, archives, packing, mixing, media, classifiers and quality rules.

Nothing outside this folder (and corpus_pipeline.py) imports it. Every operator takes a session and DataFrames and gives
DataFrames; what must survive lost executors is written to the folder named by spark.checkpoint.dir.
"""
