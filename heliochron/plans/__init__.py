"""End-to-end plans made of the operators: logger minutes to days, irradiance days, forecast scores."""
