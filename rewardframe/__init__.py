"""rewardframe: code-task dataset preparation, verification, reward scoring and evaluation on Spark."""
