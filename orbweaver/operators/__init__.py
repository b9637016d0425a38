"""orbweaver.operators"""
