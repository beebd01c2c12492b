"""Structured Streaming: windowed grid means, drifter sets, buoy input."""
