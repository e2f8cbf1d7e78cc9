"""Curation engine for labelled multimodal clips, built on PySpark DataFrames."""
