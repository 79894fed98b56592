"""Part of gridmeter, a spreadsheet machine-readability engine on Spark."""
