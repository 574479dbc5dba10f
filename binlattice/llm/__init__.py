"""Training-data operators: fixity audit, scoring, de-duplication, decontamination, packing and secret scans."""
