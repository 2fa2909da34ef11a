"""Programs: their text, their compiled form and their application to DataFrames."""
