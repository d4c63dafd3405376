"""Line-oriented text analytics on Spark."""
