"""Training-data operators for text (tagged llm). Nothing outside this package imports it."""
