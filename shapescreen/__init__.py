"""Ligand-based virtual screening on Spark DataFrames.

A *molecule* is one row: keys, label and a packed array of conformers sorted by
energy.  Everything else (screening, model training, evaluation) is a Spark job
over such rows.
"""
