"""Program text, macros and the analysis of rules."""
