"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Every operator takes DataFrames and returns a DataFrame. Executors need this
package on their Python path (``--py-files`` or an installed wheel).
"""
