"""boardlens: batch analytics over timestamped texts and daily market data, on Spark DataFrames."""
