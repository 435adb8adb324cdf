"""Training-data operators: packing, scoring, tokenising, joining and searching text at corpus scale."""
